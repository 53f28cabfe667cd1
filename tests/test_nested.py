"""Nested inputs, redaction, checks and the corpus merge on small cases."""

import json

from pyspark.sql import functions as F

from saltmarsh.operators import merging, nested


def orders(spark, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    good, bad = nested.normalised_orders(spark.createDataFrame(rows, "key int, payload string"))
    return {r.key: r for r in good.collect()}, {r.key: r.error for r in bad.collect()}


def test_channels(spark):
    good, bad = orders(
        spark,
        {"channel": "SHOPEE", "order_sn": "A1", "is_gift": True, "recipient_address": {"name": "An"}, "item_list": [{"item_sku": "s", "item_name": "", "model_discounted_price": "12.5 vnd"}, {"item_sku": 7, "model_quantity_purchased": 3}]},
        {"channel": "tiktok", "order_id": 55, "is_gift": "true", "line_items": [{"seller_sku": "t", "product_name": "T", "quantity": 0, "sale_price": 1e3}, {}]},
        {"channel": "web", "id": 9, "billing": {"first_name": "Binh"}, "line_items": [{"sku": "w", "name": "W", "quantity": 2, "price": "x"}]},
        {"channel": "web", "id": 9, "line_items": []},
        {"channel": "web", "line_items": [{"sku": "w"}]},
        {"channel": "web", "id": 1, "line_items": {"sku": "w"}},
        {"channel": "lazada", "id": 1},
        {"id": 1},
        "{broken",
        None,
        "[1]",
    )
    items = lambda k: [tuple(x) for x in good[k]["items"]]
    assert (good[0].external_id, good[0].customer, good[0].is_gift) == ("SHOPEE-A1", "An", True) and items(0) == [("s", "s", 1, 12.5), ("7", "7", 3, 0.0)]
    assert (good[1].external_id, good[1].customer, good[1].is_gift) == ("TIKTOK-55", None, False) and items(1) == [("t", "T", 1, 1000.0), (None, None, 1, 0.0)]
    assert (good[2].external_id, good[2].customer) == ("WOO-9", "Binh") and items(2) == [("w", "W", 2, 0.0)]
    assert bad == {3: "no items", 4: "no order id", 5: "no items", 6: "unknown channel: lazada", 7: "unknown channel: ", 8: "not JSON", 9: "not JSON", 10: "unknown channel: "}


def test_redaction(spark):
    deep = {"a": [{"internal": {"x": 1}, "b": ["sk-" + "k" * 24, 5, None, True]}], "margin": None, "url": "see postgres://u:p@h/d now", "đ": 1.5}
    rows = [(1, json.dumps(deep)), (2, "{broken"), (3, None), (4, '"npg_abcdefgh12"'), (5, "[" * 5000 + "]" * 5000), (6, "")]
    good, bad = nested.redacted(spark.createDataFrame(rows, "id int, t string"), "t")
    got = {r.id: r.t for r in good.collect()}
    assert json.loads(got[1]) == {"a": [{"internal": nested.HIDDEN, "b": [nested.SECRET, 5, None, True]}], "margin": nested.HIDDEN, "url": f"see {nested.SECRET} now", "đ": 1.5}
    assert got[4] == f'"{nested.SECRET}"'
    assert {2, 3, 6} <= {r.id for r in bad.collect()} and {r.id for r in bad.collect()} | set(got) == {1, 2, 3, 4, 5, 6}


INVOICE = "key int, items array<struct<price:double,qty:int>>, total double"


def test_invoice_outcomes(spark):
    rows = [(1, [(1.0, 1)], 1.1), (2, [(-1.0, 0), (None, None)], 0.0), (3, None, None), (4, [], 5.0), (5, [(2.0, 1)], 9.0)]
    df = spark.createDataFrame(rows, INVOICE)
    totals = spark.createDataFrame([(1, True), (2, True), (5, False)], "key int, is_valid boolean")
    got = {r.key: (r.outcome, r.issues) for r in nested.scanned_invoices(df, totals).collect()}
    assert got == {
        1: ("ok", ""),
        2: ("schema_invalid", "total must be > 0; items[0]: price must be >= 0; items[0]: qty must be >= 1; items[1]: price: missing"),
        3: ("schema_invalid", "items: missing; total: missing"),
        4: ("review", ""),
        5: ("review", ""),
    }


def test_quarantine_is_one_pass_with_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, [(1.0, 1)], 1.1), (2, [(-1.0, 0)] * 40, 0.0), (3, None, None)], INVOICE)
    counts = nested.quarantined(df, nested.invoice_issues(), str(tmp_path))
    assert counts == {"good": 1, "bad": 2}
    back = {r.key: r for r in spark.read.parquet(str(tmp_path)).collect()}
    assert {k: r.outcome for k, r in back.items()} == {1: "good", 2: "bad", 3: "bad"} and len(back[2].error) == nested.MAX_MESSAGE and len(back[2].issues) == 81 and back[1].error is None


def test_scans_and_confidence(spark):
    schema = "k int, overall_confidence double, items array<struct<quantity:double,unit_price:double,confidence:double>>"
    rows = [(1, 0.9, [(1.0, 2.0, 0.5)]), (2, None, [(None, 2.0, 0.3), (1.0, None, None)]), (3, 0.1, []), (4, 0.9, None)]
    got = {r.k: r.i for r in spark.createDataFrame(rows, schema).select("k", nested.scan_issues().alias("i")).collect()}
    low = "confidence too low"
    assert got[1] == [] and got[3] == got[4] == ["no items"]
    assert got[2] == ["overall " + low, "items[0]: no quantity or unit price", f"items[0]: {low}", "items[1]: no quantity or unit price", f"items[1]: {low}"]
    known = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (-0.1,), (None,)], "confidence double").select(F.size(nested.confidence_issues())).collect()
    assert [r[0] for r in known] == [0, 0, 1, 1, 0]


NODE = '{"name": "%s", "type": "%s", "typeVersion": 1, "position": [0, 0]}'
FLOW = '"nodes": [' + NODE % ("start", "webhook") + ", " + NODE % ("work", "http") + '], "connections": {"start": {"main": [[{"node": "%s"}]]}}'
ASKED = [("system", "s"), ("user", "q")]


def test_every_reason(spark):
    said = lambda a: [*ASKED, ("assistant", a)]
    cases = {
        "malformed": [None, [], [("user", "q")], [("system", "s"), ("user", "q")], [("system", "s"), ("assistant", "a")], said(""), said('{"other": 1}'), said('```json\n{"x": 1}\n```')],
        "make_com": [[("system", "You make Make.com JSON."), ("user", "q"), ("assistant", '{"flow": []}')], said('x "__IMTCONN__" y')],
        "empty_after_strip": [said("<think>only"), said("<think>x</think> \n\t")],
        "sql_action": [said('<think>x</think>{"action": "query_db", "sql": "SELECT 1"}')],
        "workflow_ok": [said("<think>x</think>\n```json\n{" + FLOW % "work" + "}\n```"), said('{"action": "create_workflow", "name": "n", "payload": {' + FLOW % "work" + "}}")],
        "workflow_invalid": [said("{" + FLOW % "nowhere" + "}"), said('{"nodes": []}'), said('{"action": "create_workflow"}'), said('{"nodes": [' + ", ".join(NODE % (f"n{i}", "http") for i in range(13)) + "]}")],
        "too_long": [said("x" * 12_001)],
        "report_ok": [said("x" * 1_401), said("<think>y</think>" + "x" * 12_000)],
        "ok": [said("<think>reasons</think>\nOrder six weeks ahead."), said("An essay on \"nodes\" and {braces}."), said('prose, then {"x": 1}')],
    }
    rows = [(i, reason, m) for i, (reason, m) in enumerate((r, m) for r, ms in cases.items() for m in ms)]
    samples = spark.createDataFrame([(i, m) for i, _, m in rows], "id int, messages array<struct<role:string,content:string>>")
    catalog = spark.createDataFrame([("webhook", True), ("http", False)], "type string, is_trigger boolean")
    got = {r.id: r for r in merging.convert(samples, catalog, ["code"]).collect()}
    assert {i: got[i].reason for i, _, _ in rows} == {i: reason for i, reason, _ in rows}
    for i, reason, _ in rows:
        assert (got[i].kind is not None) == (reason in merging.KINDS) == (got[i].answer is not None)
    by_reason = {r.reason: r for r in got.values()}
    assert by_reason["workflow_ok"].answer.startswith("{") and "<think>" not in (by_reason["ok"].answer or "")


def test_sources_are_accounted_for(spark):
    schema = "id int, messages array<struct<role:string,content:string>>"
    a, b = spark.createDataFrame([(1, [*ASKED, ("assistant", "fine")]), (2, None)], schema), spark.createDataFrame([(1, [*ASKED, ("assistant", "fine")])], schema)
    catalog = spark.createDataFrame([("webhook", True)], "type string, is_trigger boolean")
    rows = merging.account(merging.merge({"a": a, "b": b}, catalog, [])).collect()
    assert sorted((r.source, r.reason, r.samples, r.kept) for r in rows) == [("a", "malformed", 1, 0), ("a", "ok", 1, 1), ("b", "ok", 1, 1)]


def test_orders_are_parsed_once(spark):
    """No filter on the error is pushed down with the parsing in it."""
    payloads = spark.range(3).selectExpr("CAST(id AS int) AS key", "concat('{\"channel\": \"web\", \"id\": ', id, '}') AS payload")
    for rows in nested.normalised_orders(payloads.join(spark.range(9).selectExpr("CAST(id AS int) AS key"), "key")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
