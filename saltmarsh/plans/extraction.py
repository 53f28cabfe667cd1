"""Queries of JSON extraction, arithmetic and nested inputs, with their DuckDB counterparts.

The answers of a model are put together from the given tables: an event's properties, the document of the event's number and its page, in one of five shapes by the event's type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.arithmetic import calculate
from saltmarsh.functions.text import SPACE
from saltmarsh.operators import extraction, merging, nested
from saltmarsh.sources.tables import table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, answer)"""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text", "source")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "html")
    joined = events.join(docs, "event_id").join(pages, "event_id", "left")
    note = F.col("text")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        note = F.replace(note, F.lit(plain), F.lit(escaped))
    whole = F.concat(F.lit('{"action": "'), "event_type", F.lit('", "note": "'), note, F.lit('", "periods": ['), "props", F.lit("]}"))
    html = F.coalesce("html", F.lit("no page }"))
    kind = F.col("event_type")
    answer = (
        F.when(kind == "view", F.concat("props", F.lit(" "), "text", whole))
        .when(kind == "click", F.concat(html, F.lit("\n"), whole, F.lit(" {done}")))
        .when(kind == "purchase", F.concat("text", F.lit("\n```json\n"), whole, F.lit("\n``` or "), "props"))
        .when(kind == "error", F.substring(whole, F.lit(1), F.length(whole) - 1))
        .otherwise(F.col("text"))
    )
    return joined.select("event_id", "user_id", answer.alias("answer"))


_ANSWERS = r"""parts AS (SELECT event_id, user_id, event_type, props, text, coalesce(html, 'no page }') AS html,
    '{"action": "' || event_type || '", "note": "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '", "periods": [' || props || ']}' AS whole
    FROM events JOIN documents ON doc_id = event_id LEFT JOIN pages ON page_id = event_id),
answers AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN props || ' ' || text || whole WHEN 'click' THEN html || chr(10) || whole || ' {done}'
    WHEN 'purchase' THEN text || chr(10) || '```json' || chr(10) || whole || chr(10) || '``` or ' || props WHEN 'error' THEN left(whole, length(whole) - 1) ELSE text END AS answer FROM parts)"""
_CHARS = "letters AS (SELECT event_id, unnest(string_split(answer, '')) AS c, generate_subscripts(string_split(answer, ''), 1) AS i FROM answers)"


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir).select("event_id", extraction.first_object(F.col("answer")).alias("f"))
    return found.select("event_id", F.md5("f.block").alias("block_md5"), "f.reason")


FIRST_SQL = f"""WITH {_ANSWERS}, {_CHARS},
begun AS (SELECT *, min(i) FILTER (c = '{{') OVER (PARTITION BY event_id) AS start FROM letters),
-- how many backslashes stand right before each letter, from the first brace on
backs AS (SELECT *, i - 1 - coalesce(max(i) FILTER (c <> '\\' OR i <= start) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i - 1) AS run FROM begun WHERE i >= start),
plain AS (SELECT *, count(*) FILTER (c = '"') OVER (PARTITION BY event_id ORDER BY i) % 2 = 1 AS inside FROM backs WHERE run % 2 = 0),
depth AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 END) OVER (PARTITION BY event_id ORDER BY i) AS d FROM plain WHERE NOT inside AND c IN ('{{', '}}')),
ends AS (SELECT event_id, min(start) AS start, min(i) AS stop FROM depth WHERE d = 0 GROUP BY event_id),
blocks AS (SELECT event_id, answer, substr(answer, start, stop - start + 1) AS block FROM answers LEFT JOIN ends USING (event_id))
SELECT event_id, CASE WHEN json_valid(block) THEN md5(block) END AS block_md5,
    CASE WHEN coalesce(answer, '') = '' THEN 'empty output' WHEN NOT contains(answer, '{{') THEN 'no JSON object found' WHEN block IS NULL THEN 'unbalanced braces' WHEN NOT json_valid(block) THEN 'invalid JSON' END AS reason FROM blocks"""


def any_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.select("event_id", F.md5(extraction.any_object(F.col("answer"))).alias("block_md5"), F.md5(extraction.any_object(F.col("answer"), fences=True)).alias("fenced_md5"))


_FENCES = r"list_transform(list_filter(regexp_extract_all(answer, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1), lambda x: json_valid(x)), lambda x: x)"
ANY_SQL = f"""WITH {_ANSWERS}, {_CHARS},
depth AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY event_id ORDER BY i) AS d FROM letters WHERE c IN ('{{', '}}')),
spans AS (SELECT event_id, i AS stop, d, c, max(i) FILTER (c = '{{' AND d = 1) OVER (PARTITION BY event_id ORDER BY i) AS start FROM depth),
blocks AS (SELECT event_id, start, substr(answer, start, stop - start + 1) AS block FROM spans JOIN answers USING (event_id) WHERE c = '}}' AND d = 0 AND start IS NOT NULL),
good AS (SELECT event_id, arg_min(block, start) AS block FROM blocks WHERE json_valid(block) GROUP BY event_id)
SELECT event_id, md5(block) AS block_md5, md5(coalesce({_FENCES}[1], block)) AS fenced_md5 FROM answers LEFT JOIN good USING (event_id)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir).select("event_id", extraction.keyed_object(F.col("answer")).alias("block"))
    action = F.try_variant_get(extraction.value(F.col("block")), "$.action", "string")
    return found.select("event_id", F.md5("block").alias("block_md5"), action.alias("action"))


KEYED_SQL = f"""WITH RECURSIVE {_ANSWERS}, {_CHARS},
braces AS (SELECT event_id, c, i, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY event_id ORDER BY i) AS s FROM letters WHERE c IN ('{{', '}}')),
floored AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY event_id ORDER BY i)) AS d FROM braces),
told AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY event_id ORDER BY i), 0) AS was FROM floored),
spans AS (SELECT event_id, i AS stop, c, was, max(i) FILTER (c = '{{' AND was = 0) OVER (PARTITION BY event_id ORDER BY i) AS start FROM told),
blocks AS (SELECT event_id, list(substr(answer, start, stop - start + 1) ORDER BY start) AS found FROM spans JOIN answers USING (event_id) WHERE c = '}}' AND was = 1 GROUP BY event_id),
every AS (SELECT event_id, list_concat({_FENCES}, list_filter(coalesce(found, []), lambda x: json_valid(x))) AS found FROM answers LEFT JOIN blocks USING (event_id)),
chosen AS (SELECT event_id, coalesce(list_filter(found, lambda x: json_exists(x, '$.action'))[-1], found[-1]) AS block FROM every)
SELECT event_id, md5(block) AS block_md5, json_extract_string(block, '$.action') AS action FROM chosen"""


def latest_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's answers as a conversation, in the order of the events."""
    said = _answers(spark, sf_dir).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return extraction.explainable(said).select("conv_id", "turn", F.md5("block").alias("block_md5"))


LATEST_SQL = FIRST_SQL.rpartition("SELECT event_id, CASE")[0] + """SELECT user_id AS conv_id, max(event_id) AS turn, md5(arg_max(block, event_id)) AS block_md5 FROM blocks JOIN (SELECT event_id, user_id FROM answers) USING (event_id)
WHERE json_valid(block) AND len(list_intersect(json_keys(block), ['explain', 'ranked', 'internal', 'periods', 'warnings'])) > 0 GROUP BY user_id"""


# ---- arithmetic ------------------------------------------------------------------------------------------------


def calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as an expression, of a form that its flag decides; the line's number makes some of them divide by zero."""
    q, n, t = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.round(F.col("l_tax") * 100).cast("int").cast("string")
    form = (
        F.when(F.col("l_returnflag") == "A", F.concat(q, F.lit(" + "), n, F.lit(" * ("), t, F.lit(" - 3) ** 2 / ("), n, F.lit(" - 4)")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("-("), q, F.lit(" % "), n, F.lit(") ** 2 - -"), t))
        .otherwise(F.concat(q, F.when(F.col("l_linestatus") == "F", " + ").otherwise(" +* "), n))
    )
    told = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", calculate(form).alias("v"))
    return told.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("v").try_cast("double"), 6).alias("value"), (F.col("v") == "Error").alias("error"))


CALCULATED_SQL = """WITH l AS (SELECT *, l_quantity::INT::DOUBLE AS q, l_linenumber::DOUBLE AS n, round(l_tax * 100) AS t FROM lineitem),
v AS (SELECT *, CASE l_returnflag WHEN 'A' THEN CASE WHEN n <> 4 THEN q + n * pow(t - 3, 2) / (n - 4) END WHEN 'N' THEN -pow(q % n, 2) + t ELSE CASE WHEN l_linestatus = 'F' THEN q + n END END AS x FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, round(x, 6) AS value, x IS NULL AS error FROM v"""


# ---- nested inputs ---------------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a channel would send them: the channel by priority, some of another one, cut off, or without an id or items."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("lines"))  # noqa: E741
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    qty = lambda x: F.when(x["l_quantity"] <= 45, F.when(x["l_quantity"] > 1, x["l_quantity"].cast("int")).otherwise(0))
    sku = lambda x: x["l_partkey"].cast("string")
    price = lambda x: x["l_extendedprice"].cast("decimal(12,2)")
    gift = (F.col("o_orderstatus") == "O").alias("is_gift")
    person = F.struct(F.concat(F.lit("C"), "o_custkey").alias("name")).alias("recipient_address")
    shopee = F.to_json(F.struct(F.lit("Shopee").alias("channel"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("order_sn"), person, gift, F.transform("lines", lambda x: F.struct(sku(x).alias("item_sku"), F.concat(F.lit("n"), sku(x)).alias("item_name"), qty(x).alias("model_quantity_purchased"), price(x).cast("string").alias("model_discounted_price"))).alias("item_list")))
    tiktok = F.to_json(F.struct(F.lit("tiktok").alias("channel"), F.col("o_orderkey").cast("string").alias("order_id"), person, F.lit("yes").alias("is_gift"), F.transform("lines", lambda x: F.struct(sku(x).alias("seller_sku"), qty(x).alias("quantity"), price(x).alias("sale_price"))).alias("line_items")))
    billing = F.struct(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), "o_custkey")).alias("first_name"), F.lit("X").alias("last_name")).alias("billing")
    web = F.to_json(F.struct(F.lit("web").alias("channel"), F.col("o_orderkey").alias("id"), billing, F.transform("lines", lambda x: F.struct(sku(x).alias("sku"), F.lit("").alias("name"), qty(x).alias("quantity"), F.concat(price(x).cast("string"), F.lit(" đ")).alias("price"))).alias("line_items")))
    p = F.col("o_orderpriority")
    low = F.when(F.col("o_orderstatus") == "P", F.substring(web, F.lit(1), F.length(web) - 1)).when(F.col("o_orderstatus") == "F", shopee).otherwise(F.to_json(F.struct(F.lit("web").alias("channel"), F.col("o_orderkey").alias("id"), F.array().cast("array<string>").alias("line_items"))))
    payload = F.when(p == "1-URGENT", shopee).when(p == "2-HIGH", tiktok).when(p == "3-MEDIUM", web).when(p == "5-LOW", low).otherwise(F.replace(web, F.lit('"web"'), F.lit('"lazada"')))
    return o.select(F.col("o_orderkey").alias("key"), payload.alias("payload"))


def channel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = nested.normalised_orders(_payloads(spark, sf_dir))
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["qty"] * x["price"])
    units = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["qty"])
    return good.select("key", "channel", "external_id", "customer", "is_gift", F.size("items").cast("long").alias("n_items"), units.alias("units"), F.round(total, 2).alias("total"), F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("names"))


CHANNEL_SQL = """WITH l AS (SELECT l_orderkey, count(*) AS n_items, sum(CASE WHEN l_quantity BETWEEN 2 AND 45 THEN l_quantity::INT ELSE 1 END)::BIGINT AS units,
    round(sum(CASE WHEN l_quantity BETWEEN 2 AND 45 THEN l_quantity::INT ELSE 1 END * l_extendedprice::DECIMAL(12,2)::DOUBLE), 2) AS total, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS skus,
    string_agg('n' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS named FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS key, CASE o_orderpriority WHEN '1-URGENT' THEN 'shopee' WHEN '2-HIGH' THEN 'tiktok' ELSE 'web' END AS channel, CASE o_orderpriority WHEN '1-URGENT' THEN 'SHOPEE-' WHEN '2-HIGH' THEN 'TIKTOK-' ELSE 'WOO-' END || o_orderkey AS external_id,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'C' || o_custkey WHEN o_orderstatus = 'F' THEN 'C' || o_custkey || ' X' END AS customer, o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AS is_gift, n_items, units, total, CASE WHEN o_orderpriority = '1-URGENT' THEN named ELSE skus END AS names
FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderpriority < '4'"""


def channel_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = nested.normalised_orders(_payloads(spark, sf_dir))
    return bad.select("key", "error")


REJECTS_SQL = """SELECT o_orderkey AS key, CASE WHEN o_orderpriority < '5' THEN 'unknown channel: lazada' WHEN o_orderstatus = 'P' THEN 'not JSON' WHEN o_orderstatus = 'F' THEN 'no order id' ELSE 'no items' END AS error
FROM orders WHERE o_orderpriority >= '4' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries with secrets at several depths; those of clicks are cut off."""
    secret = F.concat(F.lit("sk-"), F.sha1(F.col("event_id").cast("string")))
    text = F.concat(F.lit('{"user": '), "user_id", F.lit(', "internal": {"cost": '), "value", F.lit('}, "lines": [{"margin": '), "value", F.lit(', "note": "key '), secret, F.lit(' at postgresql://svc:k9@db/x end"}, ['), "props", F.lit("]]}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("entry"))
    good, bad = nested.redacted(rows, "entry")
    return good.select("event_id", F.col("entry").alias("logged")).unionByName(bad.select("event_id", F.lit("quarantined").alias("logged")))


REDACTION_SQL = """SELECT event_id, CASE WHEN event_type = 'click' THEN 'quarantined' ELSE '{"user": ' || user_id || ', "internal": "[ĐÃ ẨN]", "lines": [{"margin": "[ĐÃ ẨN]", "note": "key [SECRET] at [SECRET] end"}, [' || props || ']]}' END AS logged FROM events"""


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price = F.when(F.col("l_discount") < 0.1, F.when(F.col("l_tax") > 0.075, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", price.alias("price"), (F.col("l_quantity").cast("int") - 1).alias("qty"), F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("unit_price"), (1 - F.col("l_tax") * 8).alias("confidence"))
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("sum"), F.max("l_discount").alias("d"))
    o = table(spark, sf_dir, "orders").join(rows, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.lit(0.0))
    return o.select(F.col("o_orderkey").alias("key"), "items", total.alias("total"), (F.lit(1.0) - F.col("d") * 6).alias("overall_confidence"), (F.col("o_totalprice") < F.col("sum")).alias("is_valid"))


def invoice_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _invoices(spark, sf_dir)
    return nested.scanned_invoices(rows, rows.select("key", "is_valid"))


OUTCOMES_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount < .1 THEN CASE WHEN l_tax > .075 THEN -l_extendedprice ELSE l_extendedprice END END NULLS FIRST) - 1 AS i FROM lineitem),
e AS (SELECT l_orderkey, i, unnest([1, 2, 3]) AS k, unnest([CASE WHEN l_discount >= .1 THEN 'price: missing' END, CASE WHEN l_discount < .1 AND l_tax > .075 THEN 'price must be >= 0' END, CASE WHEN l_quantity::INT - 1 < 1 THEN 'qty must be >= 1' END]) AS what FROM l),
g AS (SELECT l_orderkey, string_agg('items[' || i || ']: ' || what, '; ' ORDER BY i, k) AS issues FROM e WHERE what IS NOT NULL GROUP BY l_orderkey),
s AS (SELECT l_orderkey, sum(l_extendedprice * l_quantity) AS total FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_orderkey AS key, o_totalprice < s.total AS valid, concat_ws('; ', CASE WHEN s.l_orderkey IS NULL THEN 'items: missing' END, CASE WHEN o_orderstatus = 'P' THEN 'total must be > 0' END, issues) AS issues FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey)
SELECT key, CASE WHEN issues <> '' THEN 'schema_invalid' WHEN valid THEN 'ok' ELSE 'review' END AS outcome, issues FROM t"""


def scan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _invoices(spark, sf_dir).withColumn("issues", nested.scan_issues()).filter(F.size("issues") > 0)
    return told.select("key", F.array_join("issues", "; ").alias("issues"))


SCAN_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount < .1 THEN CASE WHEN l_tax > .075 THEN -l_extendedprice ELSE l_extendedprice END END NULLS FIRST) - 1 AS i FROM lineitem),
e AS (SELECT l_orderkey, i, unnest([1, 2]) AS k, unnest([CASE WHEN l_quantity >= 49 THEN 'no quantity or unit price' END, CASE WHEN 1 - l_tax * 8 < .4 THEN 'confidence too low' END]) AS what FROM l),
g AS (SELECT l_orderkey, string_agg('items[' || i || ']: ' || what, '; ' ORDER BY i, k) AS issues FROM e WHERE what IS NOT NULL GROUP BY l_orderkey),
d AS (SELECT l_orderkey, max(l_discount) AS d FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_orderkey AS key, CASE WHEN d.d IS NULL THEN 'no items' ELSE concat_ws('; ', CASE WHEN 1.0 - d.d * 6 < .5 THEN 'overall confidence too low' END, issues) END AS issues FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey)
SELECT key, issues FROM t WHERE issues <> ''"""


# ---- old samples -----------------------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents answered in the five shapes that old samples have, by the type of the event of the same number; a workflow's soundness goes by language."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", "value")
    d = table(spark, sf_dir, "documents").join(events, "doc_id")
    node = lambda name, kind: f'{{"name": "{name}", "type": "{kind}", "typeVersion": 1, "position": [0, 0]}}'
    flow = lambda dest: f'"nodes": [{node("start", "webhook")}, {node("work", "http")}], "connections": {{"start": {{"main": [[{{"node": "{dest}", "type": "main", "index": 0}}]]}}}}'
    kind = F.col("event_type")
    answer = (
        F.when(kind == "signup", F.concat(F.lit("<think>"), F.substring("text", 1, 200), F.lit("</think>\n"), "text"))
        .when(kind == "view", F.concat(F.lit(" <think>"), "text"))
        .when(kind == "click", F.when(F.col("value") < 10, F.lit('so {"action": "query_db", "sql": "SELECT 1"}')).otherwise(F.lit('{"action": "reply"} done')))
        .when(kind == "purchase", F.when(F.col("lang") == "fr", F.lit("```json\n{" + flow("nowhere") + "}\n```")).when(F.col("lang") == "en", F.lit("{" + flow("work") + "}")).otherwise(F.lit('{"action": "create_workflow", "name": "w", "payload": {' + flow("work") + "}}")))
        .otherwise(F.lit(""))
    )
    system = F.when(F.col("lang") == "de", F.when(F.col("value") > 15, "You make Make.com blueprints.").otherwise("You help.")).otherwise("You help.")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.when(F.col("value") < 1, F.array(message("system", system))).otherwise(F.array(message("system", system), message("user", F.col("source")), message("assistant", answer)))
    return d.select(F.col("doc_id").alias("id"), "lang", messages.alias("messages"))


def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    catalog = spark.createDataFrame([("webhook", True), ("http", False)], "type string, is_trigger boolean")
    sources = {"western": s.filter("lang IN ('en', 'de')").select("id", "messages"), "other": s.filter("lang NOT IN ('en', 'de')").select("id", "messages")}
    return merging.account(merging.merge(sources, catalog, ["code"]))


MERGED_SQL = f"""WITH s AS (SELECT lang, event_type, value, text, {{strip}} AS t FROM documents JOIN events ON event_id = doc_id),
r AS (SELECT CASE WHEN lang IN ('en', 'de') THEN 'western' ELSE 'other' END AS source, CASE WHEN value < 1 THEN 'malformed' WHEN lang = 'de' AND value > 15 OR event_type = 'signup' AND contains(text, 'Make.com') THEN 'make_com' WHEN event_type = 'error' THEN 'malformed' WHEN event_type = 'view' THEN 'empty_after_strip'
    WHEN event_type = 'click' THEN CASE WHEN value < 10 THEN 'sql_action' ELSE 'malformed' END WHEN event_type = 'purchase' THEN CASE WHEN lang = 'fr' THEN 'workflow_invalid' ELSE 'workflow_ok' END
    WHEN t = '' THEN 'empty_after_strip' WHEN length(t) > 12000 THEN 'too_long' WHEN length(t) > 1400 THEN 'report_ok' ELSE 'ok' END AS reason FROM s)
SELECT source, reason, count(*) AS samples, CASE WHEN reason IN ('ok', 'report_ok', 'workflow_ok') THEN count(*) ELSE 0 END AS kept FROM r GROUP BY source, reason""".replace("{strip}", f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')")


QUERIES = {
    "json_first_object": first,
    "json_any_object": any_one,
    "json_keyed_object": keyed,
    "explainable_answer": latest_explained,
    "calculator": calculated,
    "channel_orders": channel_orders,
    "channel_rejects": channel_rejects,
    "redaction": redaction,
    "invoice_outcomes": invoice_outcomes,
    "scan_checks": scan_checks,
    "corpus_merge": merged_corpus,
}
ORACLES = {
    "json_first_object": FIRST_SQL,
    "json_any_object": ANY_SQL,
    "json_keyed_object": KEYED_SQL,
    "explainable_answer": LATEST_SQL,
    "calculator": CALCULATED_SQL,
    "channel_orders": CHANNEL_SQL,
    "channel_rejects": REJECTS_SQL,
    "redaction": REDACTION_SQL,
    "invoice_outcomes": OUTCOMES_SQL,
    "scan_checks": SCAN_SQL,
    "corpus_merge": MERGED_SQL,
}
