"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` places on a ring of ``points`` places. A row's key (its text, so
that copies stay together where room allows) hashes to a place, and the next virtual node
clockwise is its arc. Every shard has a capacity; the rows of an arc whose shard is full go
on clockwise to the next shards with room. With capacities that differ by one at most and sum
to the number of rows, all shards end up full, whatever the keys.

Only DataFrame functions are used. The one sequential part, the walk around the ring, is a fold
over ``shards * vnodes`` counts, whatever the number of rows. A hot arc is no task of its own:
rows are numbered in (arc, cell) pieces, and a window over the pieces' counts gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ring(spark: SparkSession, shards: int, vnodes: int, points: int) -> DataFrame:
    """The virtual nodes: arc (0 is the first one clockwise from place 0), place, shard."""
    nodes = spark.range(0, shards * vnodes, 1, 1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("vnode"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(points)).alias("place"),
    )
    order = Window.orderBy("place", "shard")
    return nodes.groupBy("place").agg(F.min("shard").alias("shard")).select((F.row_number().over(order) - 1).alias("arc"), "place", "shard")


def _arcs_of_places(nodes: DataFrame, points: int) -> DataFrame:
    """The arc of every place: that of the next virtual node clockwise, the first one after the last."""
    spark = nodes.sparkSession
    ahead = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)  # a running value; one that looks forward is computed anew for each row
    marked = spark.range(0, points, 1, 1).withColumnRenamed("id", "place").join(nodes.select("place", "arc"), "place", "left")
    return marked.select("place", F.coalesce(F.last("arc", ignorenulls=True).over(ahead), F.lit(0)).cast("int").alias("arc"))


def _fill(counts: Column, capacities: Column) -> Column:
    """Walk the arcs clockwise; give each one's rows to its shard and on to the next ones with room.

    counts: array of (arc, n, turn), turn being the arc's shards in clockwise order. Returns pieces
    (arc, shard, low, high, base): rows low to high-1 of the arc have slots from base on in the shard.
    """
    piece = "array<struct<arc:int,shard:int,low:bigint,high:bigint,base:bigint>>"
    used = F.transform(capacities, lambda _: F.lit(0).cast("bigint"))
    start = F.struct(used.alias("used"), F.array().cast(piece).alias("pieces"))

    def one_shard(arc: Column):
        def step(state: Column, shard: Column) -> Column:
            have = F.element_at(state["used"], shard + 1)
            take = F.least(arc["n"] - state["low"], F.element_at(capacities, shard + 1) - have)
            new = F.struct(arc["arc"].alias("arc"), shard.alias("shard"), state["low"].alias("low"), (state["low"] + take).alias("high"), have.alias("base"))
            return F.when(take <= 0, state).otherwise(
                F.struct(
                    F.transform(state["used"], lambda x, i: F.when(i == shard, x + take).otherwise(x)).alias("used"),
                    F.concat(state["pieces"], F.array(new)).cast(piece).alias("pieces"),
                    (state["low"] + take).alias("low"),
                )
            )

        return step

    def one_arc(state: Column, arc: Column) -> Column:
        begin = F.struct(state["used"].alias("used"), F.array().cast(piece).alias("pieces"), F.lit(0).cast("bigint").alias("low"))
        done = F.aggregate(arc["turn"], begin, one_shard(arc))
        return F.struct(done["used"].alias("used"), F.concat(state["pieces"], done["pieces"]).alias("pieces"))

    return F.aggregate(counts, start, one_arc)["pieces"]


def assign_shards(
    df: DataFrame,
    shards: int = 16,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = 64,
    points: int = 1 << 14,
    cells: int = 256,
) -> DataFrame:
    """Deal the rows of ``df`` to shards ``0..shards-1``, whose counts differ by one at most.

    Returns one row per input row: the id, ``size`` (UTF-8 bytes of the text plus 1; a null text has
    none), ``text_crc32`` (unsigned, of the UTF-8 bytes; of a null text that of no bytes, 0), ``law``
    ('rows'), ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null: under this
    law a further shard would also move rows between the others, if few). Other columns of ``df``
    aren't read. Repeated rows each get a slot of their own; rows that are equal in id and text
    share an order, and which of them has which slot isn't told apart. A null id is a row like
    others. An empty table gives an empty result. Equal texts hash to one place; they stay in one
    shard as long as it has room.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = ring(spark, shards, vnodes, points)
    rows = df.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ).select("*", F.pmod("key", F.lit(points)).alias("place"), F.pmod(F.xxhash64(id_col, "key"), F.lit(cells)).cast("int").alias("cell"))
    # points rows of 12 bytes: a size fixed by the parameter
    rows = rows.join(F.broadcast(_arcs_of_places(nodes, points)), "place")

    pieces = rows.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    # At most shards * vnodes rows from here to the fold.
    whole = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owners = nodes.select("arc", F.collect_list(F.struct("arc", "shard")).over(whole).alias("owners"))
    turn = F.expr("array_distinct(transform(concat(filter(owners, x -> x.arc >= arc), filter(owners, x -> x.arc < arc)), x -> x.shard))")
    arcs = pieces.groupBy("arc").agg(F.sum("n").alias("n")).join(owners, "arc").select("arc", "n", turn.alias("turn"))
    total = arcs.agg(F.array_sort(F.collect_list(F.struct(F.col("arc").cast("int").alias("arc"), "n", "turn"))).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    capacities = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("rows") / shards) + F.when(i < F.col("rows") % shards, 1).otherwise(0))
    plan = (
        total.select("counts", capacities.alias("capacities"))
        .select(F.explode(_fill(F.col("counts"), F.col("capacities"))).alias("p"))
        .select(F.col("p.arc").alias("arc"), F.col("p.shard").alias("shard"), F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.base").alias("base"))
    )

    in_cell = Window.partitionBy("arc", "cell").orderBy("key", id_col)
    numbered = rows.withColumn("n", F.row_number().over(in_cell) - 1).join(offsets, ["arc", "cell"])
    numbered = numbered.withColumn("at", F.col("n") + F.col("offset"))
    # At most shards * (vnodes + 1) pieces: a size fixed by the parameters.
    p = F.broadcast(plan.withColumnRenamed("arc", "piece_arc"))
    return numbered.join(p, (F.col("arc") == F.col("piece_arc")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("at") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
