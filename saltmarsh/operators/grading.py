"""Grades of a model's work against what was expected, gates, and reports and notices of the shop floor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.text import customer_leak, invented_numbers, stripped

FOLD = "UNICODE_CI_AI"  # neither case nor accents count
MAX_NG = 3.0  # percent
MAX_NOTICE = 3800  # characters of a notice
#: Channels that notices may go to; the first one takes all others. Fixed values.
NOTICE_CHANNELS = ("discord", "telegram", "zalo", "facebook")


def _same(a: Column, b: Column) -> Column:
    return F.collate(a, FOLD) == F.collate(b, FOLD)


def _value(c: Column) -> Column:
    """A field's text without white space around it; nothing if blank."""
    return F.nullif(stripped(c.cast("string")), F.lit(""))


def graded_fields(expected: DataFrame, got: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """(key, kind, field, outcome): correct, false_fill, miss or wrong; case, accents and white space around don't count. A row that wasn't answered misses all it should have. Keys are unique; null keys take no part."""

    def long(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).select(key, *more, *[_value(F.col(f)).alias(f) for f in fields]).unpivot([key, *more], fields, "field", name)

    both = long(expected, "want", kind).join(long(got, "got"), [key, "field"], "left")
    w, g = F.col("want"), F.col("got")
    outcome = F.when(w.isNull() & g.isNull(), "correct").when(w.isNull(), "false_fill").when(g.isNull(), "miss").when(_same(w, g), "correct").otherwise("wrong")
    return both.select(key, F.col(kind).alias("kind"), "field", outcome.alias("outcome"))


def extraction_report(graded: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Of each kind, and of all (kind null): rows, the share of fields that are correct, of each outcome the count, and the share of rows that are ready: all required fields correct."""
    right = F.col("outcome") == "correct"
    rows = graded.groupBy(key, "kind").agg(F.every(right | ~F.col("field").isin(required)).alias("ready"))
    by_row = rows.rollup("kind").agg(F.count("*").alias("rows"), F.round(F.avg(F.col("ready").cast("int")), 4).alias("ready_rate"), F.grouping("kind").alias("_all"))
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "false_fill", "miss", "wrong")]
    by_field = graded.rollup("kind").agg(F.round(F.avg(right.cast("int")), 4).alias("field_rate"), *counts, F.grouping("kind").alias("_all"))
    joined = by_row.join(by_field, by_row["kind"].eqNullSafe(by_field["kind"]) & (by_row["_all"] == by_field["_all"]))
    return joined.select(by_row["kind"], (by_row["_all"] == 1).alias("all_kinds"), "rows", "ready_rate", "field_rate", "correct", "false_fill", "miss", "wrong")


def agent_report(turns: DataFrame) -> DataFrame:
    """Tool choice and asking back. turns: tool (expected; null: none), got_tool, ask (should ask back), asked. Each rate is over the turns that it is about; null without any."""
    rate = lambda of, right: F.round(F.avg(F.when(of, F.coalesce(right, F.lit(False)).cast("int"))), 4)
    return turns.agg(
        F.count("*").alias("turns"),
        rate(F.col("tool").isNotNull(), F.col("tool") == F.col("got_tool")).alias("tool_rate"),
        rate(F.coalesce("ask", F.lit(False)), F.col("asked")).alias("ask_back_rate"),
        rate(F.col("tool").isNull(), F.col("got_tool").isNull()).alias("restraint_rate"),
    )


def narration_report(answers: DataFrame, kind: str) -> DataFrame:
    """Of each kind: answers, those with a number that their context hasn't, those with a word for insiders, and the share with neither. answers: answer, context."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    told = answers.select(kind, (F.size(invented_numbers(empty("answer"), empty("context"))) > 0).alias("invents"), (F.size(customer_leak(empty("answer"))) > 0).alias("leaks"))
    good = ~(F.col("invents") | F.col("leaks"))
    return told.groupBy(kind).agg(F.count("*").alias("answers"), F.count_if("invents").alias("invented"), F.count_if("leaks").alias("leaked"), F.round(F.avg(good.cast("int")), 4).alias("pass_rate"))


def gates(report: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(gate, value, threshold, passed) of a report of one row: an unknown value doesn't pass."""
    each = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(t).alias("threshold")) for k, t in thresholds.items()])
    return report.select(F.inline(each)).withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def sample_faults(samples: DataFrame) -> DataFrame:
    """The faults of each training sample (id, messages): too few messages, no reasoning, reasoning too short, braces that don't balance; in this order, none if sound."""
    answer = F.coalesce(F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))
    thought = F.substring_index(F.substring_index(answer, "</think>", 1), "<think>", -1)
    braces = F.length(answer) - F.length(F.replace(answer, F.lit("{"), F.lit(""))) - F.length(answer) + F.length(F.replace(answer, F.lit("}"), F.lit("")))
    reasons = [
        ("fewer than 3 messages", F.coalesce(F.size("messages"), F.lit(0)) < 3),
        ("no reasoning", ~(F.contains(answer, F.lit("<think>")) & F.contains(answer, F.lit("</think>")))),
        ("reasoning under 150 characters", F.contains(answer, F.lit("</think>")) & (F.length(stripped(thought)) < 150)),
        ("unbalanced braces", braces != 0),
    ]
    return samples.select("id", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons]), lambda x: x.isNotNull()).alias("faults"))


def seed_faults(seeds: DataFrame, domains: dict[str, list[str]], length: tuple[int, int] = (30, 600)) -> DataFrame:
    """The faults of each seed (id, prompt, and a column for each domain): a value outside its domain, a prompt too short or long, or one that an earlier seed has too (case and white space around don't count)."""
    prompt = F.lower(stripped(F.coalesce("prompt", F.lit(""))))
    keyed = seeds.withColumn("_p", prompt)
    firsts = keyed.groupBy("_p").agg(F.min("id").alias("_first"))
    reasons = [(f"{k} not known", ~F.coalesce(F.col(k).isin(v), F.lit(False))) for k, v in domains.items()]
    reasons += [("prompt too short", F.length("_p") < length[0]), ("prompt too long", F.length("_p") > length[1]), ("prompt repeats", F.col("id") != F.col("_first"))]
    rows = keyed.join(firsts, "_p")
    return rows.select("id", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons]), lambda x: x.isNotNull()).alias("faults"))


def weather(rain: Column, temperature: Column) -> Column:
    """Rainy above 50, else hot above 35 degrees, else sunny; unknown figures don't count."""
    return F.when(rain > 50, "Rainy").when(temperature > 35, "Hot").otherwise("Sunny")


def batch_report(batches: DataFrame, warn_yield: float) -> DataFrame:
    """Yield, rejects and profit of each batch (batch, planned, good, rejected, revenue, cost), by sums over its rows. Warned where the yield is below ``warn_yield`` percent or rejects are above 3 %."""
    names = ("planned", "good", "rejected", "revenue", "cost")
    rows = batches.groupBy("batch").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    share = lambda a, b: F.round(100 * a / F.nullif(b, F.lit(0)), 2)
    rows = rows.select("batch", share(F.col("good"), F.col("planned")).alias("yield_pct"), share(F.col("rejected"), F.col("good") + F.col("rejected")).alias("ng_pct"), F.round(F.col("revenue") - F.col("cost"), 2).alias("profit"))
    return rows.withColumn("warn", F.coalesce((F.col("yield_pct") < warn_yield) | (F.col("ng_pct") > MAX_NG), F.lit(False)))


def routed_notices(notices: DataFrame) -> DataFrame:
    """Each notice (id, channel, text) with its channel, or the default one where that isn't known, and its text cut to what a notice may have."""
    asked = F.lower(F.coalesce("channel", F.lit("")))
    return notices.select("id", F.when(asked.isin(*NOTICE_CHANNELS), asked).otherwise(NOTICE_CHANNELS[0]).alias("channel"), F.substring(F.coalesce("text", F.lit("")), 1, MAX_NOTICE).alias("text"))


def invoice_versions(issued: DataFrame, adjustments: DataFrame, fields: list[str]) -> DataFrame:
    """All versions of electronic invoices (invoice, ``fields``): the issue is version 0, adjustments (invoice, seq, ``fields``) follow in order; none is changed. Adds the SHA-256 of invoice, version and fields for the backup.

    An adjustment of an invoice that was never issued isn't there; a field that it leaves null keeps what came before.
    """
    kinds = {f: issued.schema[f].dataType for f in fields}
    more = adjustments.join(issued.select("invoice"), "invoice", "left_semi").select("invoice", F.col("seq").cast("long").alias("_seq"), *[F.col(f).cast(k).alias(f) for f, k in kinds.items()])
    rows = issued.select("invoice", F.lit(None).cast("long").alias("_seq"), *fields).unionByName(more)
    order = Window.partitionBy("invoice").orderBy(F.col("_seq").asc_nulls_first())
    kept = [F.last(f, ignorenulls=True).over(order).alias(f) for f in fields]
    rows = rows.select("invoice", (F.row_number().over(order) - 1).alias("version"), *kept)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("invoice", "version", *fields)]
    return rows.withColumn("sha256", F.sha2(reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts), 256))
