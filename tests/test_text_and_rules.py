"""Text functions, corpus checks, rules and streaming on small fixtures."""

from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import corpus, quotes, retrieval, selection, sessions
from saltmarsh.sources import sinks, tables
from saltmarsh.streaming import flows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_cleaning(spark):
    line = "x" * 50
    assert one(spark, f"<think>a</think>{line}\n{line}\nok", T.clean_output) == f"{line}\nok"
    assert one(spark, "<think>never closed", T.clean_output) == T.EMPTY_ANSWER
    assert one(spark, "lost</think>kept", T.clean_output) == "kept"
    assert one(spark, f'{{"a":\n{line}\n{line}}}', T.dedupe_lines).count(line) == 2
    assert one(spark, "a [USER REQUEST] hi there [X] b", T.user_content) == "hi there"
    assert one(spark, "![i](u)# A [b](c)", T.clean_markdown) == "A b"


def test_numbers_and_leaks(spark):
    assert one(spark, "3.450.000đ và 12", T.numbers_in) == ["3450000", "12"]
    df = spark.createDataFrame([("giá 5.000 và 77.000", "5000")], "a string, c string")
    assert df.select(T.invented_numbers(F.col("a"), F.col("c"))).first()[0] == ["77000"]
    assert one(spark, "lại nói về lãi", T.customer_leak) == ["lãi"]


def test_secrets_masks_and_guard(spark):
    assert one(spark, "postgresql://svc:k9@db/x", T.found_secrets)
    assert not one(spark, "postgres://user:password@host/x", T.found_secrets)
    assert one(spark, "a sk-" + "b" * 24, T.redact) == "a [SECRET]"
    assert one(spark, "0912345678", T.mask_phone) == "XXXXXXX678"
    assert one(spark, "anna@x.vn", T.mask_email) == "a***@x.vn"
    assert one(spark, "select 1; delete from t", T.guard_sql) == "writes: DELETE"
    assert one(spark, "select 1", T.guard_sql) is None
    assert one(spark, "Hải Phòng", lambda c: T.fuzzy_contains(c, F.lit("hai phong")))


def test_trimming(spark):
    """All white space of any script goes at both ends, none within."""
    inner = "a\u3000b\tc"
    for space in T.SPACES:
        assert one(spark, space + inner + space * 2, T.stripped) == inner, hex(ord(space))
    assert one(spark, "\u200bx\u200b", T.stripped) == "\u200bx\u200b" and one(spark, None, T.stripped) is None and one(spark, " \n", T.stripped) == ""
    assert "".join(c for c in map(chr, range(0x3100)) if c.isspace()) == "".join(sorted(T.SPACES))


def test_dialogues_that_are_wrong_in_one_way(spark):
    good = [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a")]
    cases = {1: good, 2: good[:2], 3: good[1:] + [(3, "user", "x")], 4: [*good, (3, "assistant", "b")], 5: [*good, (3, "user", "u")], 6: [*good[:2], (2, "assistant", " \t")], 7: [*good[:2], (2, "assistant", None)]}
    df = spark.createDataFrame([(k, *m) for k, rows in cases.items() for m in rows], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.fault for r in corpus.shape_errors(df).collect()}
    empty = "last message is empty"
    assert got == {1: None, 2: "fewer than 3 messages", 3: "first message isn't the system's", 4: "roles don't alternate", 5: "last message isn't the assistant's", 6: empty, 7: empty}


def test_chunks(spark):
    for n, want in ((1, 1), (120, 1), (121, 2), (150, 2), (0, 0)):
        df = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id long, text string")
        assert retrieval.chunk_words(df).count() == want


def test_router(spark):
    rows = [("báo giá xe 5 tấn", "LOGISTICS"), ("VÌ SAO chọn hãng này", "EXPLAIN"), ("phân tích doanh thu quý này", "REPORT"), ("tạo workflow gửi mail", "TECHNICAL"), ("thuế vat là gì", "RETRIEVAL"), ("xin chào", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select("t", retrieval.keyword_route(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == dict(rows)


def test_history_begins_with_the_user(spark):
    rows = [("c", 0, "assistant", "hello"), ("c", 1, "user", "hi"), ("c", 2, "assistant", ""), ("c", 3, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert [r.turn for r in sessions.sanitize_history(df).orderBy("turn").collect()] == [1, 3]


def test_split_and_cap(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = corpus.stratified_split(df, "source", "doc_id").groupBy("source").agg(F.count_if(F.col("split") == "eval").alias("e")).collect()
    assert all(r.e == 2 for r in got)
    assert corpus.share_cap(df, F.col("doc_id") >= 20, "doc_id").count() == 20 + int(0.55 / (1 - 0.55) * 20)


def test_fefo_refuses_when_short(spark):
    lots = spark.createDataFrame([("a", "1", "2026-01-02", 5), ("a", "2", "2026-01-01", 3), ("b", "3", "2026-01-01", 1)], "sku string, lot string, expiry string, qty int")
    needs = spark.createDataFrame([("a", 4), ("b", 2)], "sku string, need int")
    got = {r.lot: r.taken for r in selection.allocate_fefo(lots, needs).collect()}
    assert got == {"2": 3, "1": 1, "3": 0}


def test_as_of_price(spark):
    e = spark.createDataFrame([("k", 5, 1), ("k", 1, 2)], "key string, ts int, id int")
    p = spark.createDataFrame([("k", 2, 7.0), ("k", 5, 8.0)], "key string, ts int, price double")
    assert {r.id: r.price for r in quotes.price_as_of(e, p, "key").collect()} == {1: 8.0, 2: None}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n')
    good, bad = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1
    (tmp_path / "s.csv").write_text("id,types\nx,1.5T|3T\n")
    assert tables.read_sheet(spark, str(tmp_path / "s.csv"), "id string, types string", ("types",)).first().types == ["1.5T", "3T"]
    df, path = spark.range(3).withColumnRenamed("id", "k"), str(tmp_path / "t")
    sinks.append(df, path)
    sinks.append_new(spark, spark.range(5).withColumnRenamed("id", "k"), path, "k")
    assert spark.read.parquet(path).count() == 5
    try:
        sinks.gated(df, F.col("k") == 1, lambda d: sinks.append(d, str(tmp_path / "never")))
        raise AssertionError
    except ValueError:
        assert not (tmp_path / "never").exists()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2026-01-01 00:00:00", "view", 1.0), (1, "2026-01-01 00:00:00", "view", 1.0), (2, "2026-01-01 02:00:00", "error", 3.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = flows.idempotent_stream(flows.read_events(spark, source, events.schema), ["event_id"])
    flows.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    metrics = flows.windowed_metrics(flows.read_events(spark, source, events.schema))
    flows.run_available(metrics, str(tmp_path / "m"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "m")).agg(F.sum("n")).first()[0] in (2, 3)
