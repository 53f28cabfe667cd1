"""Laboratory gates, and traces from a batch to its lots and their farmers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.sources.shared import saved

SLICES, SLICE_ROWS = 16, 250_000  # slices of batches at most, and lots of batches from which on there are more


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, up, depth): every node that one comes from, through any number of edges (node, up), with the fewest steps. Cycles end; a node in one comes from itself.

    Each round joins what is known with itself, so ways double in length: as many rounds as the longest way has binary digits.
    """
    reach, state = saved(edges.select("node", "up").dropna().distinct().withColumn("depth", F.lit(1)), "ways"), None
    while True:
        now = reach.agg(F.count("*"), F.sum("depth")).first()
        if now == state:
            return reach
        state = now
        ahead = reach.select(F.col("node").alias("_via"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        longer = reach.join(ahead, F.col("up") == F.col("_via")).select("node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        reach = saved(reach.unionByName(longer).groupBy("node", "up").agg(F.min("depth").alias("depth")), "ways")


def lab_gate(tests: DataFrame) -> DataFrame:
    """(batch, status, reasons): passed if all criteria are met, else blocked. tests: batch, criterion, value, low, high (null: open).

    A value that is missing isn't met; a batch without tests isn't here. Reasons are distinct and in order. One aggregate, with few distinct reasons for each batch.
    """
    text = lambda c: F.coalesce(F.format_number(c, 4), F.lit(""))
    low, high = F.coalesce(F.col("value") >= F.col("low"), F.col("low").isNull()), F.coalesce(F.col("value") <= F.col("high"), F.col("high").isNull())
    reason = F.when(F.col("value").isNull(), F.concat(F.coalesce("criterion", F.lit("?")), F.lit(": not measured"))).when(~(low & high), F.concat(F.coalesce("criterion", F.lit("?")), F.lit(": not in "), text("low"), F.lit(".."), text("high")))
    found = tests.select("batch", reason.alias("reason")).groupBy("batch").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return found.select("batch", F.when(F.size("reasons") == 0, "passed").otherwise("blocked").alias("status"), "reasons")


def _lots(lots: DataFrame, up: DataFrame, farmers: DataFrame) -> DataFrame:
    """(lot, ways, farmers) of each lot: itself and all lots it comes from, with their steps, and the distinct farmers of them all."""
    ways = lots.select(F.col("lot").alias("node"), "lot", F.lit(1).alias("steps")).unionByName(up.join(lots, up["node"] == lots["lot"], "left_semi").select("node", F.col("up").alias("lot"), (F.col("depth") + 1).alias("steps")))
    whose = farmers.select("lot", "farmer").dropna().groupBy("lot").agg(F.collect_set("farmer").alias("_farmers"))
    found = ways.join(whose, "lot", "left").groupBy("node").agg(F.collect_list(F.struct("lot", "steps")).alias("ways"), F.collect_list("_farmers").alias("_farmers"))
    return found.select(F.col("node").alias("lot"), "ways", F.array_sort(F.array_distinct(F.flatten("_farmers"))).alias("farmers"))


def _walks(own: DataFrame, told: DataFrame) -> DataFrame:
    """(batch, n_lots, steps, n_farmers, first_farmer) of batches, from what is told of their own lots: a row for each of these, with its lists."""
    found = own.join(told, "lot").groupBy("batch").agg(F.flatten(F.collect_list("ways")).alias("_ways"), F.array_distinct(F.flatten(F.collect_list("farmers"))).alias("_farmers"))
    ordered = found.withColumn("_ways", F.array_sort("_ways"))  # by lot, then steps: the first of a lot is its shortest way
    steps = F.transform(F.filter(F.col("_ways"), lambda x, i: (i == 0) | (x["lot"] != F.get(F.col("_ways"), i - 1)["lot"])), lambda x: x["steps"])
    found = ordered.withColumn("_steps", steps)
    return found.select("batch", F.size("_steps").alias("n_lots"), F.array_max("_steps").alias("steps"), F.size("_farmers").alias("n_farmers"), F.array_min("_farmers").alias("first_farmer"))


def trace_batches(tests: DataFrame, made_of: DataFrame, mixed: DataFrame, farmers: DataFrame) -> DataFrame:
    """The gate's verdict of each batch and, of blocked ones, where to look: all lots it comes from and their farmers.

    made_of: batch, lot; mixed: lot, from_lot (lots that a lot was mixed of); farmers: lot, farmer. Adds ``n_lots``, ``n_farmers``, ``steps`` (the longest way to a lot,
    1 for the batch's own lots; each lot by its shortest way) and ``first_farmer``, the smallest; 0 and null where nothing is known. Lots are traced once, with the distinct farmers of all their ways, whatever
    the batches that hold them. Batches are then worked out slice by slice, and a slice's shuffle files go before the next one's are made.
    """
    gate = lab_gate(tests)
    blocked = gate.filter("status = 'blocked'").select("batch")
    own = made_of.dropna().distinct().join(blocked, "batch", "left_semi")
    up = ancestors(mixed.select(F.col("lot").alias("node"), F.col("from_lot").alias("up")))
    told = saved(_lots(made_of.select("lot").dropna().distinct(), up, farmers), "lots")
    own = saved(own, "own")
    slices = max(1, min(SLICES, own.count() // SLICE_ROWS))
    parts = [saved(_walks(own.filter(F.pmod(F.xxhash64("batch"), F.lit(slices)) == k), told), "walks", clean=True) for k in range(slices)]
    found = reduce(DataFrame.unionByName, parts)
    rows = gate.join(found, "batch", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select("batch", "status", "reasons", zero("n_lots"), zero("n_farmers"), zero("steps"), "first_farmer")
