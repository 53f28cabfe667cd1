"""Places in sorted groups, ranks by hash and lots, against plain loops, also where one key holds all rows."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import corpus, selection, sessions

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def brute(rows, offset):
    out = {}
    for k in {k for k, _ in rows}:
        own = sorted((v for g, v in rows if g == k and v is not None), key=lambda v: (math.isnan(v), v))
        if own:
            out[k] = (len(own), *(own[max(0, min(len(own) - 1, math.floor(s * len(own)) - offset))] for s in SHARES.values()))
    return out


@pytest.mark.parametrize("few,cuts,offset", [(1_000_000, 64, 0), (20, 8, 1)])
def test_places(spark, monkeypatch, few, cuts, offset):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "CUTS", cuts)
    rng = random.Random(few)
    rows = [("hot", rng.choice([1.0, 1.0, 2.5, rng.random() * 1e6, -rng.random(), 1e300])) for _ in range(400)]
    rows += [("same", 7.0)] * 50 + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), ("nan", float("nan")), ("nan", 1.0), ("inf", float("-inf")), ("inf", float("inf")), ("inf", 0.0)]
    got = selection.index_percentile(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", SHARES, offset).collect()
    assert repr({r.k: (r.n, r.p0, r.p50, r.p95, r.p100) for r in sorted(got, key=lambda r: str(r.k))}) == repr(dict(sorted(brute(rows, offset).items(), key=lambda x: str(x[0]))))


def test_places_of_an_empty_table(spark):
    assert selection.index_percentile(spark.createDataFrame([], "k string, v double"), ["k"], "v", SHARES).count() == 0


def test_split_of_a_hot_stratum(spark):
    rows = [(i, "hot" if i % 10 else None) for i in range(3000)]
    got = {r.i: r.split for r in corpus.stratified_split(spark.createDataFrame(rows, "i long, s string"), "s", "i").collect()}
    for s in ("hot", None):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, g in rows if g == s)
        evals = {i for _, i in own[: max(1, math.floor(len(own) * 0.08))]}
        assert {i for _, i in own if got[i] == "eval"} == evals


def test_latest_session_ties_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 10, t), (1, 11, t), (1, 12, None), (2, 20, None), (None, 30, t)]
    got = sessions.latest_session(spark.createDataFrame(rows, "user_id long, session_id long, last_active timestamp_ntz")).collect()
    assert {r.user_id: r.session_id for r in got} == {1: 11, 2: 20, None: 30}


def loop_fefo(lots, need, gift):
    order = sorted(lots, key=lambda x: (x[1] or dt.date(9999, 12, 31), x[0]))
    enough = sum(q or 0 for _, _, q in order) >= need + gift
    out = {}
    for name, left, lots in (("taken", need, order), ("gift", gift, order[::-1])):
        for lot, _, qty in lots:
            take = max(0, min(qty or 0, left)) if enough else 0
            left -= take
            out.setdefault(lot, {})[name] = take
    return enough, out


def test_lots_of_one_hot_sku(spark):
    rng = random.Random(3)
    day = dt.date(2024, 1, 1)
    lots = [("hot", f"L{rng.randrange(10**6)}-{i}", day + dt.timedelta(rng.randrange(400)), rng.choice([0, 1, 5, 40, None])) for i in range(800)]
    lots += [("hot", "no expiry", None, 30), ("short", "a", day, 3), (None, "x", day, 3), ("unasked", "u", day, 1)]
    needs = [("hot", 2000, 500), ("short", 3, 1), ("nothing there", 1, 0), (None, 1, 1)]
    df = selection.allocate_fefo(
        spark.createDataFrame(lots, "sku string, lot string, expiry date, qty long").repartition(6), spark.createDataFrame(needs, "sku string, need long, gift long"), F.lit(day)
    ).collect()
    enough, want = loop_fefo([x[1:] for x in lots if x[0] == "hot"], 2000, 500)
    assert enough and {r.lot: (r.taken, r.gift_taken) for r in df if r.sku == "hot"} == {k: (v["taken"], v["gift"]) for k, v in want.items()}
    assert [(r.taken, r.gift_taken, r.enough, r.near_expiry) for r in df if r.sku == "short"] == [(0, 0, False, False)]
    assert {r.sku for r in df} == {"hot", "short"}
    for r in df:
        assert r.near_expiry == (r.taken + r.gift_taken > 0 and r.expiry is not None and (r.expiry - day).days < 90)


def test_lots_without_gifts(spark):
    lots = spark.createDataFrame([("s", "a", dt.date(2024, 1, 1), 2), ("s", "b", dt.date(2024, 1, 1), 2)], "sku string, lot string, expiry date, qty long")
    got = selection.allocate_fefo(lots, spark.createDataFrame([("s", 3)], "sku string, need long")).collect()
    assert sorted((r.lot, r.taken, r.gift_taken, r.near_expiry) for r in got) == [("a", 2, 0, None), ("b", 1, 0, None)]
