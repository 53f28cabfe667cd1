"""What each of several filters removes, in every order of applying them: forward-backward path counting.

A state is the set of filters applied so far, as bits; an edge applies one more. The rows that an edge
removes depend on its state only, not on the order that led there. So each state's kept rows are counted once, an edge removes
the difference of its ends, and an order is a path from the empty state to the full one whose steps are edges.
A filter's removals over all orders are its edges', each weighted by the paths through it: those that reach its
state times those that leave the state behind it.

Documents are reduced to counts of (part, failed filters) before anything else; a part has 2**filters of these at most.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._salted import with_group_values

MAX_FILTERS = 8
NULL_SALTS = 512


def path_counts(n: int, before: tuple[tuple[int, int], ...] = ()) -> tuple[list[int], list[int]]:
    """For each state of ``n`` filters: the orders of its filters that reach it, and the orders of the others that leave it.

    ``before``: pairs (i, j) where filter i is applied before j in every order; a state that no order passes has 0 in one of both.
    """
    needs = [sum(1 << i for i, k in before if k == j) for j in range(n)]
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for j in range(n):
            if not state >> j & 1 and needs[j] & ~state == 0:
                forward[state | 1 << j] += forward[state]
    for state in range(full, -1, -1):
        for j in range(n):
            if not state >> j & 1 and needs[j] & ~state == 0:
                backward[state] += backward[state | 1 << j]
    return forward, backward


def orders(names: str, before: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """All orders of the filters (one letter each), as strings."""
    found = ("".join(p) for p in permutations(names))
    return [x for x in found if all(x.index(a) < x.index(b) for a, b in before)]


def failure_cells(
    docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, mask, n, good, toxic): the rows of each part by the filters that they fail, bit i for filter i.

    ``rules``: a condition of failure for each letter, on ``_text`` (the text, a null one empty), ``_words`` (its words), ``_n_words``
    and ``_n_distinct``. ``copies``: a further letter, failed by a row whose text a smaller id has too, anywhere in the table. Rows with a null id fail no such filter and make no other row fail.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    split = docs.select(key.alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    counted = split.select("*", F.size(words).alias("_n_words"), F.size(F.array_distinct(words)).alias("_n_distinct"))
    mask = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    rows = counted.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_SALTS))).otherwise(F.lit(0)))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("bigint"))
    held = rows.join(marks, ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    # keys that begin with the join's need no further shuffle; a hot text is as many rows as (part, labels) from here on
    alike = held.groupBy("doc_id", "salt", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    groups = alike.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
    )
    if copies is None:
        cells = groups.select("part", "good", "toxic", "mask", "n")
    else:
        marked = with_group_values(groups, ["digest"], {"least": ("min", F.col("first.doc_id"))}, ["part", "good", "toxic"])
        fresh = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
        bit = 1 << len(rules)
        both = F.array(F.struct(F.col("mask").alias("mask"), fresh.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - fresh).alias("n")))
        cells = marked.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    some = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def audit_orders(cells: DataFrame, names: str, before: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """For each part, order and step of ``names`` (eight letters at most): what the step's filter does, and its removals over all orders.

    ``kept`` (rows after this step), ``removed`` (here), ``redundant`` (fail the filter, gone before), ``unique_fails`` (fail it only), ``good_lost`` and
    ``toxic_lost`` (removed here), ``shapley`` (the filter's removed, summed over all orders). No cells give no rows.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS or len(set(names)) != n:
        raise ValueError(f"one to {MAX_FILTERS} filters, each with a letter of its own")
    full, spot = (1 << n) - 1, {x: i for i, x in enumerate(names)}
    forward, backward = path_counts(n, tuple((spot[a], spot[b]) for a, b in before))
    weights = F.array(*[F.lit(0 if s >> f & 1 else forward[s] * backward[s | 1 << f]).cast("bigint") for s in range(full + 1) for f in range(n)])

    powers = F.array(*[F.lit(1 << i) for i in range(n)])

    # kept rows of each state: those that fail none of its filters
    states = cells.withColumn("state", F.explode(F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("mask")) == 0)))
    kept = states.groupBy("part", "state").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    known = kept.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "good", "toxic")))).alias("known"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("n", "good", "toxic")])
    known = known.select("part", F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.coalesce(F.try_element_at("known", s), none)).alias("kept"))

    def edge(place: Column) -> Column:
        """Edge state * n + filter: what it removes, and the orders through it; nothing where the filter is in the state."""
        state, f = (place / n).cast("int"), (place % n).cast("int")
        here = F.element_at("kept", state + 1)
        there = F.element_at("kept", state.bitwiseOR(F.element_at(powers, f + 1)) + 1)
        return F.struct(f.alias("f"), F.element_at(weights, place + 1).alias("paths"), *[(here[x] - there[x]).alias(x) for x in ("n", "good", "toxic")])

    edges = known.select("part", "kept", F.transform(F.sequence(F.lit(0), F.lit((full + 1) * n - 1)), edge).alias("edges"))
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.aggregate(F.filter("edges", lambda e: e["f"] == f), F.lit(0).cast("bigint"), lambda total, e: total + e["paths"] * e["n"]),
    )
    steps = edges.select("*", shares.alias("shares"), F.explode(F.split(F.lit(" ".join(orders(names, before))), " ")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def bits(prefix: Column) -> Column:
        return sum((F.when(F.instr(prefix, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))

    letter, prefix = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    place = sum((F.when(letter == x, i).otherwise(0) for i, x in enumerate(names)), F.lit(0))
    steps = steps.select("*", place.alias("f"), bits(letter).alias("bit"), bits(prefix).alias("state"))
    at = lambda state: F.element_at("edges", state * n + F.col("f") + 1)
    here = at(F.col("state"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.element_at("kept", F.col("state") + F.col("bit") + 1)["n"].alias("kept"),
        here["n"].alias("removed"),
        (at(F.lit(0))["n"] - here["n"]).alias("redundant"),
        at(F.lit(full) - F.col("bit"))["n"].alias("unique_fails"),
        here["good"].alias("good_lost"),
        here["toxic"].alias("toxic_lost"),
        F.element_at("shares", F.col("f") + 1).alias("shapley"),
    )


def corpus_rules() -> dict[str, Column]:
    """Too short; few distinct words; too many capitals; signs of markup or code."""
    return {
        "A": F.col("_n_words") < 200,
        "B": 100 * F.col("_n_distinct") < 50 * F.col("_n_words"),
        "C": 100 * F.length(F.regexp_replace("_text", "[^A-Z]+", "")) > 2 * F.length("_text"),
        "D": F.col("_text").rlike(r"[#$%&*|]"),
    }


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four rules and of exact copies (E) over whole documents, for each source, in all 120 orders.

    A null text is an empty one: it has no words and fails A; the other conditions don't hold. Two empty texts are copies. A null source is the part
    '', together with empty ones. A row with a null id is in no other row's way and has no labels. Rows that repeat an id each count; equal ids are no smaller ones. Labels of an id
    that repeat count as one, set where any is. Very long texts are read whole. An empty table gives no rows. Other columns aren't read.
    """
    return audit_orders(failure_cells(docs, labels, corpus_rules(), "E"), "ABCDE")
