"""Quotes, approvals, registries and traces: plain loops, and streams against batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import quotes, sessions, tracing
from saltmarsh.streaming import flows, state

T0 = dt.datetime(2024, 1, 31, 12)


def test_price_as_of_across_pieces(spark):
    rng = random.Random(1)
    prices = [("hot", T0 + dt.timedelta(hours=rng.randrange(9000)), float(i)) for i in range(60)] + [("hot", T0, None), (None, T0, 1.0), ("b", None, 2.0)]
    events = [(i, rng.choice(["hot", "hot", "none", None]), T0 + dt.timedelta(hours=rng.randrange(-100, 9500))) for i in range(300)] + [(900, "hot", None)]
    got = quotes.price_as_of(spark.createDataFrame(events, "id long, k string, ts timestamp_ntz"), spark.createDataFrame(prices, "k string, ts timestamp_ntz, price double"), "k")
    for r in got.collect():
        known = [(t, p) for k, t, p in prices if k is not None and k == r.k and p is not None and t is not None and r.ts is not None and t <= r.ts]
        assert r.price == (max(known)[1] if known else None), r
    assert got.count() == len(events)


def test_valid_offers(spark):
    rng = random.Random(2)
    day = dt.date(2024, 1, 15)
    pick = lambda: day + dt.timedelta(rng.randrange(-60, 200)) if rng.random() < 0.8 else None
    offers = [(rng.randrange(9), rng.choice("AB"), rng.choice([10.0, 11.0, None]), pick(), pick()) for _ in range(150)] + [(1, None, 5.0, None, None)]
    requests = [(rng.choice(["A", "B", "C", None]), day + dt.timedelta(rng.randrange(0, 120))) for _ in range(60)] + [("A", None)]
    got = quotes.valid_offers(spark.createDataFrame(requests, "vehicle_type string, day date"), spark.createDataFrame(offers, "carrier_id long, vehicle_type string, price double, valid_from date, valid_to date")).collect()
    want = {}
    for v, d in requests:
        fits = sorted((p, c) for c, w, p, a, b in offers if v and d and w == v and p is not None and (a is None or a <= d) and (b is None or d <= b))
        if fits:
            want[v, d] = (len(fits), fits[0])
    assert {(r.vehicle_type, r.day): (r.n_offers, tuple(r.best)) for r in got} == want


RULES = "name string, place long, base_margin_pct double, fuel_sensitivity double, fuel_baseline_price double, min_margin_amount double, surcharge_name string, surcharge_amount double, surcharge_pct double"


def test_rules_and_payload(spark):
    day = dt.date(2024, 3, 1)
    requests = spark.createDataFrame([(1, "A", "tea", day), (2, "A", "other", day), (3, "B", None, day), (4, None, "tea", day), (5, "A", "tea", None)], "request_id long, vehicle_type string, cargo_type string, day date")
    offers = spark.createDataFrame([(7, "A", 100.0, None, None), (8, "A", 90.0, None, day - dt.timedelta(1))], "carrier_id long, vehicle_type string, price double, valid_from date, valid_to date")
    fuel = spark.createDataFrame([("diesel", dt.date(2024, 2, 1), 25.0), ("petrol", day, 99.0), ("diesel", dt.date(2024, 4, 1), 30.0)], "fuel_type string, date date, price double")
    rules = spark.createDataFrame([("tea", 3, 10.0, None, None, None, "toll", None, 2.0), ("tea", 9, 11.0, None, None, None, None, None, None), (quotes.DEFAULT_RULE, 2, 12.0, 0.5, 20.0, 5.0, None, None, None)], RULES)
    got = {r.request_id: r for r in quotes.assemble(requests, offers, rules, fuel).collect()}
    assert (got[1].carrier_id, got[1].carrier_cost, got[1].base_margin_pct, got[1].fuel_sensitivity, got[1].current_fuel_price, got[1].n_offers) == (7, 100.0, 10.0, 0.35, 25.0, 1)
    assert [tuple(s) for s in got[1].surcharges] == [("toll", 0.0, 2.0)] and got[1].min_margin_amount == 0.0
    assert (got[2].rule_name, got[2].fuel_sensitivity, got[2].surcharges) == (quotes.DEFAULT_RULE, 0.5, None)
    assert got[3].error == "no carrier fits" and got[4].error == "missing: vehicle_type" and got[5].error == "missing: day" and got[4].carrier_cost is None
    first = quotes.assemble(requests, offers, rules.filter("name = 'tea'"), fuel).filter("request_id = 2").first()
    assert first.rule_name == "tea" and first.base_margin_pct == 10.0
    assert quotes.assemble(requests, offers, rules.filter("false"), fuel).filter("request_id = 1").first().error == "no pricing rule"


DRAFTS = [(1, "pending", "a@x"), (2, "sent", "b@x"), (3, "pending", " "), (5, "pending", "e@x")]


def loop_approvals(approvals):
    drafts = {d: [s, e] for d, s, e in DRAFTS}
    out = {}
    for a, d, _ in sorted(approvals, key=lambda x: (x[2], x[0])):
        s, e = drafts.get(d, (None, None))
        out[a] = "not_found" if s is None else "already" if s != "pending" else "no_email" if not e.strip() else "sent"
        if out[a] == "sent":
            drafts[d][0] = "sent"
    return out


def test_approvals_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    approvals = [(i, rng.randrange(1, 7), T0 + dt.timedelta(minutes=rng.randrange(20))) for i in range(60)]
    batch = quotes.approve(spark.createDataFrame(approvals, "approval_id long, draft_id long, ts timestamp_ntz"), spark.createDataFrame(DRAFTS, "draft_id long, status string, customer_email string"))
    want = loop_approvals(approvals)
    assert {r.approval_id: r.outcome for r in batch.collect()} == want
    schema = "draft_id long, kind string, ts timestamp_ntz, approval_id long, status string, email string"
    ordered = sorted(approvals, key=lambda x: (x[2], x[0]))
    files = [[(d, "draft", T0, None, s, e) for d, s, e in DRAFTS], *([(d, "approval", t, a, None, None) for a, d, t in ordered[i : i + 20]] for i in range(0, 60, 20))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    for rows in files:  # a run for each file: state goes on from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.approvals_stream(flows.read_events(spark, str(tmp_path / "in"), schema))
        flows.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.approval_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_registry_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    updates, born = [], 0
    for seq in range(120):  # tasks that update are among the last few, so none returns after its eviction
        born += rng.random() < 0.6
        updates.append(("o", seq, f"t{max(0, born - rng.randrange(3))}", rng.choice(["run", "done"])))
    schema = "owner string, seq long, task_id string, status string"
    kept = {}
    for _, _, task, status in updates:
        kept[task] = status  # an update keeps its place
        while len(kept) > 8:
            kept.pop(next(iter(kept)))
    got = {r.task_id: r.status for r in sessions.registry(spark.createDataFrame(updates, schema), 8).collect()}
    assert got == kept
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    for part in (updates[:50], updates[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flows.run_available(state.registry_stream(flows.read_events(spark, str(tmp_path / "in"), schema), 8), str(tmp_path / "out"), str(tmp_path / "check"))
    events = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.seq, r.event == "evicted"))
    live = {}
    for r in events:
        live.pop(r.task_id, None) if r.event == "evicted" else live.__setitem__(r.task_id, r.status)
    assert live == kept and sum(r.event == "kept" for r in events) == len(updates)


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n0", "n9"), ("n3", None), (None, "n1")], []])
def test_ancestors(spark, edges):
    got = {(r.node, r.up): r.depth for r in tracing.ancestors(spark.createDataFrame(edges, "node string, up string")).collect()}
    step = {(a, b) for a, b in edges if a and b}
    want, now, k = {}, step, 1
    while now - set(want):
        for pair in now - set(want):
            want[pair] = k
        now, k = {(a, d) for a, b in now for c, d in step if b == c}, k + 1
    assert got == want


def test_trace(spark):
    tests = [(1, "moisture", 5.0, None, 10.0), (1, "lead", 0.1, 0.0, 0.2), (2, "moisture", 12.0, None, 10.0), (2, "moisture", 13.0, None, 10.0), (2, "lead", None, 0.0, 0.2), (3, "x", 1.0, 2.0, None)]
    df = tracing.trace_batches(
        spark.createDataFrame(tests, "batch long, criterion string, value double, low double, high double"),
        spark.createDataFrame([(1, "p"), (2, "p"), (2, "q")], "batch long, lot string"),
        spark.createDataFrame([("p", "r"), ("r", "p"), ("r", "s")], "lot string, from_lot string"),
        spark.createDataFrame([("r", "Ha"), ("s", "Binh"), ("s", "An"), ("z", "Z")], "lot string, farmer string"),
    )
    got = {r.batch: tuple(r)[1:] for r in df.collect()}
    assert got[1] == ("passed", [], 0, 0, 0, None)
    assert got[2] == ("blocked", ["lead: not measured", "moisture: not in ..10.0000"], 4, 3, 3, "An")
    assert got[3] == ("blocked", ["x: not in 2.0000.."], 0, 0, 0, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "approval_id long, draft_id long, ts timestamp_ntz")
    assert quotes.approve(none, spark.createDataFrame(DRAFTS, "draft_id long, status string, customer_email string")).count() == 0
    assert sessions.registry(spark.createDataFrame([], "owner string, seq long, task_id string, status string")).count() == 0
    assert quotes.price_as_of(spark.createDataFrame([], "k string, ts timestamp_ntz"), spark.createDataFrame([], "k string, ts timestamp_ntz, price double"), "k").select(F.col("price")).count() == 0


def test_offers_do_not_meet_each_of_their_days(spark):
    """200,000 open offers on 4,000 days are 800 million pairs, too many to be made."""
    requests = spark.range(4000).select(F.lit("truck").alias("vehicle_type"), F.date_add(F.lit("1999-03-05").cast("date"), F.col("id").cast("int")).alias("day"))
    n = F.col("id")
    offers = spark.range(200_000).select(n.alias("carrier_id"), F.lit("truck").alias("vehicle_type"), (n % 7 + 1.0).alias("price"), F.date_add(F.lit("1999-03-05").cast("date"), (n % 4000).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    began = time.monotonic()
    got = {r.day: (r.n_offers, *r.best) for r in quotes.valid_offers(requests, offers).collect()}
    assert time.monotonic() - began < 60
    first = dt.date(1999, 3, 5)
    assert got[first] == (50, 1.0, 0)
    assert got[first + dt.timedelta(3999)] == (200_000, 1.0, 0)
    assert [got[first + dt.timedelta(k)][0] for k in range(4000)] == [50 * (k + 1) for k in range(4000)]


def test_batches_are_traced_in_slices(spark, monkeypatch):
    """As plain sets, with shared lots, a cycle and lots without farmers; each slice is written for itself."""
    rng = random.Random(7)
    mixed = [(k, rng.randrange(12)) for k in range(40)] + [(3, None), (5, 41)]
    made_of = [(b, rng.randrange(44)) for b in range(60) for _ in range(3)] + [(None, 1), (61, None)]
    farmers = [(rng.randrange(30), rng.randrange(25)) for _ in range(90)] + [(1, None)]
    tests = [(b, "x", float(b % 4), None, 2.0) for b in range(62)]
    names, made = [], tracing.saved
    monkeypatch.setattr(tracing, "SLICE_ROWS", 20)
    monkeypatch.setattr(tracing, "saved", lambda df, name, **more: names.append(name) or made(df, name, **more))
    frame = spark.createDataFrame
    got = tracing.trace_batches(frame(tests, "batch long, criterion string, value double, low double, high double"), frame(made_of, "batch long, lot long"), frame(mixed, "lot long, from_lot long"), frame(farmers, "lot long, farmer long")).collect()
    assert names.count("walks") > 1
    for r in got:
        steps, now = {}, {lot for b, lot in made_of if b == r.batch and lot is not None and r.batch % 4 == 3}
        for k in range(1, 60):
            steps = {lot: k for lot in now} | steps
            now = {up for lot, up in mixed if lot in now and up is not None}
        whose = {f for lot, f in farmers if lot in steps and f is not None}
        assert (r.n_lots, r.steps, r.n_farmers, r.first_farmer) == (len(steps), max(steps.values(), default=0), len(whose), min(whose, default=None)), r
