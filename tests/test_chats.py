"""Sessions, stores, prompts and examples on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import rules, sessions

T0 = dt.datetime(2024, 1, 1)


def test_context_with_the_latest_attachment(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    shown = spark.createDataFrame([(1, T0, "a.png", "old"), (1, T0 + dt.timedelta(1), "b.png", "new"), (3, T0, None, None), (None, T0, "z", "z")], "conv_id long, ts timestamp_ntz, file_name string, summary string")
    got = {r.conv_id: (r.context, r.n) for r in sessions.context_with_attachment(messages, shown).collect()}
    head = "\n[SYSTEM: The user just uploaded an image named '%s'.]\n[IMAGE ANALYSIS]: %s\n(Use this analysis to answer questions about 'the image'.)\n\n"
    assert got == {1: (head % ("b.png", "new") + "user: hi\nassistant: ho", 2), 2: ("\nuser: x", 1), 3: (head % ("", ""), 0)}


def test_workspaces_and_stores(spark):
    stores = sessions.store_details(spark.createDataFrame([(2, None), (1, "One"), (3, "")], "id int, name string"))
    assert {r.id: r.name for r in stores.collect()} == {1: "One", 2: "Store 2", 3: "Store 3"} and stores.first().industry == "Retail"
    members = spark.createDataFrame([("u", 2), ("u", 1), ("u", 1), ("u", 9), (None, 3), ("v", None)], "user_id string, workspace_id int")
    got = sorted((str(r.user_id), r.id, r.place) for r in sessions.user_workspaces(members, stores).collect())
    assert got == [("None", 3, 1), ("u", 1, 1), ("u", 2, 2)]


def test_legacy_messages(spark):
    old = spark.createDataFrame([(7, "user", "a", T0), (7, "bot", None, T0 + dt.timedelta(1)), (None, "user", "lost", T0)], "user_id long, role string, content string, ts timestamp_ntz")
    heads, moved = sessions.legacy_sessions(old)
    assert [tuple(r) for r in heads.collect()] == [("legacy-7", 7, "Legacy Conversation", T0 + dt.timedelta(1))]
    assert sorted(r.role for r in moved.collect()) == ["bot", "user"] and {r.session_id for r in moved.collect()} == {"legacy-7"}


def test_prompts(spark):
    df = spark.createDataFrame([("gửi xe mai", dt.date(2026, 7, 27)), (None, dt.date(2026, 8, 2))], "m string, d date")
    assert [r[0] for r in df.select(T.extraction_prompt(F.col("m"), F.col("d"))).collect()] == ["Hôm nay là thứ Hai, ngày 2026-07-27.\nTin nhắn: gửi xe mai", "Hôm nay là Chủ nhật, ngày 2026-08-02.\nTin nhắn: "]
    trips = spark.createDataFrame([("A", "B", "5T", "tea", "2026-08-01"), ("A", "B", "5T", "", None)], "o string, d string, v string, c string, p string")
    assert [r[0] for r in trips.select(T.trip_summary(*map(F.col, "odvcp"))).collect()] == ["A → B, xe 5T, tea, lấy hàng 2026-08-01", "A → B, xe 5T"]


def test_example_workflows(spark):
    flow = lambda i, kinds: (i, [(f"n{k}", kind) for k, kind in enumerate(kinds)])
    rows = [flow(1, ["a"] * 2), flow(2, ["a"] * 8), flow(3, ["a", "code", "a"]), flow(4, ["a"] * 5), flow(5, ["a"] * 4), flow(6, ["a", None, "a", "a"]), (7, None)]
    got = rules.example_workflows(spark.createDataFrame(rows, "id int, nodes array<struct<name:string,type:string>>"), ["code"], 4).collect()
    assert [(r.id, r.patched, r["size"]) for r in got] == [(5, 0, 4), (6, 0, 4), (4, 0, 5), (3, 1, 3)]
    assert [n.type for n in got[3].nodes] == ["a", "noOp", "a"]
