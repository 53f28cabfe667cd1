"""Quality control of a training corpus: deduplication, caps, splits, checks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.text import stripped
from saltmarsh.operators.selection import ranked_by_hash

MAX_REPORT_CHARS, MAX_ANSWER_CHARS = 12_000, 1_400
OLD_SHARE, EVAL_SHARE = 0.55, 0.08


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row a key: that which comes first. A minimum by key is taken first, so a hot key is no task of its own."""
    keyed = df.withColumn("_k", key)
    first = keyed.groupBy("_k").agg(F.min(order).alias(order))
    return keyed.join(first, ["_k", order], "left_semi").drop("_k")


def dialogue_key(user: Column, answer: Column, chars: int = 160) -> Column:
    """What two samples share that count as the same: the question and the answer's beginning."""
    return F.md5(F.concat(stripped(user), F.lit("||"), F.substring(answer, 1, chars)))


def share_cap(df: DataFrame, old: Column, key: str, share: float = OLD_SHARE) -> DataFrame:
    """All new rows, and old ones up to ``share`` of the result, those with the smallest hash of their key."""
    marked = df.withColumn("_old", old).withColumn("_one", F.lit(1))
    cap = marked.agg(F.floor(F.lit(share) / F.lit(1 - share) * F.greatest(F.count_if(~F.col("_old")), F.lit(1))).alias("_cap"), F.lit(1).alias("_one"))
    hashed = marked.filter("_old").withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 2))
    # ranks over all old rows: within each of 256 ranges of the hash, after the rows of the ranges before
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_before")
    kept = hashed.join(before.drop("_n"), "_b").withColumn("_place", place).join(cap, "_one").filter(F.col("_place") <= F.col("_cap"))
    return marked.filter("not _old").select(df.columns).unionByName(kept.select(df.columns))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = EVAL_SHARE) -> DataFrame:
    """Add ``split``: of each stratum ``share`` of the rows, one at least, are eval, those with the smallest hash."""
    rows = ranked_by_hash(df, [stratum], key)
    return rows.withColumn("split", F.when(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_size") * share)), "eval").otherwise("train")).select(*df.columns, "split")


def fingerprint(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Number of distinct items of each group and a short hash over them in order."""
    items = F.array_sort(F.collect_set(item))
    return df.groupBy(*keys).agg(F.size(F.collect_set(item)).alias("items"), F.substring(F.sha2(F.array_join(items, "|"), 256), 1, 16).alias("fingerprint"))


def shape_errors(messages: DataFrame) -> DataFrame:
    """First fault of each conversation: fewer than 3 messages, the first not the system's, then user and assistant not in turn, or the last not an
    assistant's with text; null if sound."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = messages.withColumn("_r", place)
    due = F.when(F.col("_r") % 2 == 0, "user").otherwise("assistant")
    last = F.max_by(F.struct("role", "text"), "_r")
    wrong = F.bool_or((F.col("_r") > 1) & ~F.col("role").eqNullSafe(due))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min_by("role", "_r").alias("_first"), wrong.alias("_wrong"), last.alias("_last"))
    fault = (
        F.when(F.col("messages") < 3, "fewer than 3 messages")
        .when(~F.col("_first").eqNullSafe(F.lit("system")), "first message isn't the system's")
        .when(F.col("_wrong"), "roles don't alternate")
        .when(F.col("_last.role") != "assistant", "last message isn't the assistant's")
        .when(stripped(F.coalesce("_last.text", F.lit(""))) == "", "last message is empty")
    )
    return found.select("conv_id", "messages", fault.alias("fault"))


def convert_reason(answer: Column, action: Column) -> Column:
    """Why an old sample is kept or not, in this order: empty, sql_action, malformed_json, too_long, report_ok, ok."""
    text = stripped(F.coalesce(answer, F.lit("")))
    return (
        F.when(text == "", "empty_after_strip")
        .when(action == "sql", "sql_action")
        .when(text.startswith("{") & F.try_parse_json(text).isNull(), "malformed_json")
        .when(F.length(text) > MAX_REPORT_CHARS, "too_long")
        .when(F.length(text) > MAX_ANSWER_CHARS, "report_ok")
        .otherwise("ok")
    )


def within_budget(df: DataFrame, tokens: Column, budget: int, warn: float = 0.10) -> DataFrame:
    """Rows over and within a token budget, and the verdict: ok, warn below ``warn`` over, else fail."""
    share = F.count_if(tokens > budget) / F.count("*")
    return df.agg(
        F.count("*").alias("rows"), F.count_if(tokens > budget).alias("over"), F.when(share == 0, "ok").when(share < warn, "warn").otherwise("fail").alias("verdict")
    )


def field_scores(predicted: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field: correct, false_fill, miss and wrong, on trimmed lower text where blank is nothing."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit("")).alias(f) for f in fields]).unpivot([key], fields, "field", name)

    both = long(expected, "want").join(long(predicted, "got"), [key, "field"], "left")
    outcome = (
        F.when(F.col("want").eqNullSafe(F.col("got")), "correct").when(F.col("want").isNull(), "false_fill").when(F.col("got").isNull(), "miss").otherwise("wrong")
    )
    counts = both.withColumn("outcome", outcome).groupBy("field")
    return counts.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "false_fill", "miss", "wrong")])


def share_of_groups(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Rows, share of all rows, and least, mean and largest size of each group."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(size).alias("least"), F.round(F.avg(size), 4).alias("mean"), F.max(size).alias("largest"))
    total = groups.agg(F.sum("rows").alias("_total")).withColumn("_one", F.lit(1))
    joined = groups.withColumn("_one", F.lit(1)).join(total, "_one")
    return joined.withColumn("share", F.round(F.col("rows") / F.col("_total"), 6)).drop("_one", "_total")
