"""Grades, sample checks, reports and notices on small cases."""

from pyspark.sql import functions as F

from saltmarsh.operators import grading as G


def test_graded_fields_fold_accents(spark):
    want = spark.createDataFrame([(1, "a", "Hải Phòng", "x"), (2, "a", None, " "), (3, "b", "x", "y"), (None, "b", "q", "q")], "k int, kind string, city string, car string")
    got = spark.createDataFrame([(1, " HAI PHONG　", "y"), (2, "made up", None)], "k int, city string, car string")
    graded = G.graded_fields(want, got, "k", ["city", "car"], "kind")
    assert {(r.k, r.field): r.outcome for r in graded.collect()} == {(1, "city"): "correct", (1, "car"): "wrong", (2, "city"): "false_fill", (2, "car"): "correct", (3, "city"): "miss", (3, "car"): "miss"}
    report = {(r.kind, r.all_kinds): (r.rows, r.ready_rate, r.field_rate, r.miss) for r in G.extraction_report(graded, "k", ["city"]).collect()}
    assert report == {("a", False): (2, 0.5, 0.5, 0), ("b", False): (1, 0.0, 0.0, 2), (None, True): (3, 0.3333, 0.3333, 2)}
    passed = {r.gate: r.passed for r in G.gates(G.extraction_report(graded, "k", ["city"]).filter("all_kinds"), {"field_rate": 0.3, "ready_rate": 0.9}).collect()}
    assert passed == {"field_rate": True, "ready_rate": False}


def test_agent_rates_without_denominators(spark):
    schema = "tool string, got_tool string, ask boolean, asked boolean"
    one = G.agent_report(spark.createDataFrame([("t", "t", None, True), ("t", None, False, None)], schema)).first()
    assert (one.turns, one.tool_rate, one.ask_back_rate, one.restraint_rate) == (2, 0.5, None, None)
    none = G.agent_report(spark.createDataFrame([], schema)).first()
    assert (none.turns, none.tool_rate) == (0, None)
    two = G.agent_report(spark.createDataFrame([(None, None, True, None), (None, "x", True, True)], schema)).first()
    assert (two.tool_rate, two.ask_back_rate, two.restraint_rate) == (None, 0.5, 0.5)
    assert [r.passed for r in G.gates(G.agent_report(spark.createDataFrame([], schema)), {"tool_rate": 0.85}).collect()] == [False]


def test_narration(spark):
    rows = [("k", "giá 3.450.000đ", "3450000"), ("k", "giá 9.999", "1"), ("k", "lãi 5", "5"), ("k", None, None)]
    r = G.narration_report(spark.createDataFrame(rows, "kind string, answer string, context string"), "kind").first()
    assert (r.answers, r.invented, r.leaked, r.pass_rate) == (4, 1, 1, 0.5)


def test_samples_and_seeds(spark):
    long = "r" * 150
    rows = [(1, [("s", "x"), ("user", "q"), ("assistant", f"<think>{long}</think> {{ok}}")]), (2, [("assistant", "<think>short</think>{")]), (3, None), (4, [("s", "x"), ("user", "q"), ("assistant", None)])]
    got = {r.id: r.faults for r in G.sample_faults(spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")).collect()}
    assert got == {1: [], 2: ["fewer than 3 messages", "reasoning under 150 characters", "unbalanced braces"], 3: ["fewer than 3 messages", "no reasoning"], 4: ["no reasoning"]}
    seeds = spark.createDataFrame([(1, "p" * 40, "a"), (2, f" {'P' * 40}\n", "a"), (3, "x", None), (4, "y" * 601, "z"), (5, None, "a")], "id int, prompt string, domain string")
    got = {r.id: r.faults for r in G.seed_faults(seeds, {"domain": ["a"]}).collect()}
    assert got == {1: [], 2: ["prompt repeats"], 3: ["domain not known", "prompt too short"], 4: ["domain not known", "prompt too long"], 5: ["prompt too short"]}


def test_weather_and_batches(spark):
    df = spark.createDataFrame([(51.0, 40.0), (50.0, 35.1), (None, 36.0), (None, None)], "r double, t double")
    assert [r[0] for r in df.select(G.weather(F.col("r"), F.col("t"))).collect()] == ["Rainy", "Hot", "Hot", "Sunny"]
    rows = [(1, 100, 96, 4, 10.0, 4.0), (2, 100, 50, 1, None, 4.0), (2, 0, 45, 1, 9.0, None), (3, 0, 0, 0, None, None), (4, 100, 97, 3, 1.0, 1.0)]
    got = {r.batch: tuple(r)[1:] for r in G.batch_report(spark.createDataFrame(rows, "batch int, planned int, good int, rejected int, revenue double, cost double"), 90.0).collect()}
    assert got == {1: (96.0, 4.0, 6.0, True), 2: (95.0, 2.06, 5.0, False), 3: (None, None, 0.0, False), 4: (97.0, 3.0, 0.0, False)}


def test_notices_and_versions(spark):
    rows = [(1, "ZALO", "a" * 5000), (2, None, None), (3, "who", "é" * 3801)]
    got = {r.id: (r.channel, len(r.text)) for r in G.routed_notices(spark.createDataFrame(rows, "id int, channel string, text string")).collect()}
    assert got == {1: ("zalo", 3800), 2: ("discord", 0), 3: ("discord", 3800)}
    issued = spark.createDataFrame([(1, 10, "new"), (2, 20, None)], "invoice int, amount long, status string")
    more = spark.createDataFrame([(1, 5, None, "sent"), (1, 3, 11, None), (9, 1, 1, "x")], "invoice int, seq int, amount long, status string")
    rows = sorted((r.invoice, r.version, r.amount, r.status) for r in G.invoice_versions(issued, more, ["amount", "status"]).filter("invoice = 1").collect())
    assert rows == [(1, 0, 10, "new"), (1, 1, 11, "new"), (1, 2, 11, "sent")]
    every = G.invoice_versions(issued, more, ["amount", "status"]).collect()
    assert len(every) == 4 == len({r.sha256 for r in every})
