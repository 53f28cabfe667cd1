"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, subtracted and peeled.

A paragraph is a line, long ones cut behind ends of sentences. Its 64-bit digest goes to one cell in each of three small
tables; a cell holds how many digests came, and the xor of them and of their checks. Two sketches are
subtracted cell by cell, so what both texts have falls out. A cell with one digest left gives it away; taking it out of
its other cells uncovers more, until all digests that only one text has are known.

A sketch of fixed size, the fingerprint, is decoded like that if few paragraphs differ. Where it isn't, the pair is tried again with
larger tables: as many blocks of cells as its paragraphs may need, then four times as many each time. A digest's three cells are in
one block, so blocks are peeled one by one and a long text is many small rows.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.llm._store import stored

TABLES, SLOTS = 3, 8  # SLOTS: a power of two
CELLS = TABLES * SLOTS
LOAD = 8  # digests of both texts for each block of cells
ENDS = ".!?。！？"
PARAGRAPH = rf"([^\n]{{1,80}}[^\n{ENDS}]{{0,160}}[{ENDS}]*)"
RANGES, FINE, ROWS = 128, 8192, 2000  # ranges of ids: RANGES * FINE at most, of about ROWS rows each
MAX_TRIES = 16
_CELL = "struct<cell:int,n:bigint,key:bigint,mark:bigint>"
_STATE = f"struct<cells:array<{_CELL}>,mine:bigint,other:bigint,live:boolean>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mark(digest: Column) -> Column:
    """32 bits that tell a digest from the xor of several."""
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _slot(h: Column, table: int | Column) -> Column:
    """The cell of a hash in one of the tables."""
    shift = F.shiftright(h, 8 * table) if isinstance(table, int) else F.call_function("shiftright", h, table * 8)
    return (F.lit(table) * SLOTS + shift.bitwiseAND(F.lit(SLOTS - 1))).cast("int")


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, without white space around them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.array_distinct(F.transform(F.array_remove(found, ""), lambda x: F.xxhash64(x)))


def sketch(digests: Column) -> Column:
    """The cells of distinct digests, in order."""
    hashed = F.transform(digests, lambda x: F.struct(x.alias("x"), F.xxhash64(x, F.lit(0)).alias("h")))

    def cell(of: Column, i: Column) -> Column:
        table = (i / SLOTS).cast("int")
        own = F.filter(of, lambda e: _slot(e["h"], table) == i)
        key = lambda es: F.aggregate(es, F.lit(0).cast("bigint"), lambda s, e: s.bitwiseXOR(e["x"]))
        mark = lambda es: F.aggregate(es, F.lit(0).cast("bigint"), lambda s, e: s.bitwiseXOR(_mark(e["x"])))
        return _let(own, lambda es: F.struct(i.alias("cell"), F.size(es).cast("bigint").alias("n"), key(es).alias("key"), mark(es).alias("mark")))

    return _let(hashed, lambda of: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: cell(of, i))).cast(f"array<{_CELL}>")


def subtract(a: Column, b: Column) -> Column:
    """Cells of the first without those of the second."""
    return F.zip_with(
        a, b, lambda x, y: F.struct(x["cell"].alias("cell"), (x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["mark"].bitwiseXOR(y["mark"]).alias("mark"))
    )


def peel(cells: Column, seed: int, most: Column | int = CELLS) -> Column:
    """(done, mine, other): whether all cells could be emptied, and how many digests were of the first text and of the second only.

    ``seed``: that of the hash which dealt the digests to the cells; ``most``: digests to look for.
    """
    empty = lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["mark"] == 0)
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["mark"] == _mark(c["key"]))

    def without(state: Column, hit: Column) -> Column:
        """The state without the digest of a pure cell."""
        places = F.transform(F.array(*[F.lit(t) for t in range(TABLES)]), lambda t: _slot(F.xxhash64(hit["key"], F.lit(seed)), t))
        one = lambda c: F.struct(
            c["cell"].alias("cell"), (c["n"] - hit["n"]).alias("n"), c["key"].bitwiseXOR(hit["key"]).alias("key"), c["mark"].bitwiseXOR(hit["mark"]).alias("mark")
        )
        rest = _let(places, lambda at: F.transform(state["cells"], lambda c: F.when(F.array_contains(at, c["cell"]), one(c)).otherwise(c)))
        is_mine = F.when(hit["n"] == 1, 1).otherwise(0)
        return F.struct(rest.alias("cells"), (state["mine"] + is_mine).alias("mine"), (state["other"] + 1 - is_mine).alias("other"), F.lit(True).alias("live"))

    def step(state: Column, _: Column) -> Column:
        stuck = F.struct(state["cells"].alias("cells"), state["mine"].alias("mine"), state["other"].alias("other"), F.lit(False).alias("live"))
        hit = F.try_element_at(F.filter(state["cells"], pure), F.lit(1))
        new = _let(hit, lambda h: F.when(h.isNull(), stuck.cast(_STATE)).otherwise(without(state, h).cast(_STATE)))
        return F.when(state["live"], new).otherwise(state)

    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), F.lit(0).cast("bigint").alias("mine"), F.lit(0).cast("bigint").alias("other"), F.lit(True).alias("live")).cast(_STATE)
    turns = F.sequence(F.lit(1), F.lit(most) if isinstance(most, int) else F.greatest(most, F.lit(1)))
    return F.aggregate(turns, start, step, lambda s: F.struct(F.forall(s["cells"], empty).alias("done"), s["mine"].alias("mine"), s["other"].alias("other")))


def to_text(n: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of distinct paragraphs, and the cells in base 64."""
    wide = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    each = F.transform(cells, lambda c: F.concat(wide(c["n"], 8), wide(c["key"], 16), wide(c["mark"], 8)))
    return F.concat(n.cast("string"), F.lit(":"), F.base64(F.unhex(F.array_join(each, ""))))


def from_text(fingerprint: Column) -> Column:
    """(n, cells) of a fingerprint's text."""
    digits = F.hex(F.unbase64(F.substring_index(fingerprint, ":", -1)))
    number = lambda d, at, size: F.conv(F.substring(d, at, F.lit(size)), 16, -10).cast("bigint")

    def cells(d: Column) -> Column:
        def cell(i: Column) -> Column:
            return F.struct(i.alias("cell"), number(d, i * 32 + 1, 8).alias("n"), number(d, i * 32 + 9, 16).alias("key"), number(d, i * 32 + 25, 8).alias("mark"))

        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)

    return F.struct(F.substring_index(fingerprint, ":", 1).cast("bigint").alias("n"), _let(digits, cells).cast(f"array<{_CELL}>").alias("cells"))


def likeness(n: Column, mine: Column, other: Column) -> Column:
    """Shared paragraphs among all of both texts (1 where neither has any): ``n`` of the first, ``mine`` and ``other`` of one only."""
    return F.when(n + other == 0, F.lit(1.0)).otherwise((n - mine) / (n + other))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text (null: empty), as text."""
    return _let(paragraphs(F.coalesce(text, F.lit(""))), lambda x: to_text(F.size(x), sketch(x)))


def compare(a: Column, b: Column) -> Column:
    """Likeness from two fingerprints alone; null where so many paragraphs differ that larger tables are needed."""

    def of(x: Column, y: Column) -> Column:
        return _let(peel(subtract(x["cells"], y["cells"]), 0), lambda d: F.when(d["done"], likeness(x["n"], d["mine"], d["other"])))

    return _let(from_text(a), lambda x: _let(from_text(b), lambda y: of(x, y)))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, halo, doc_id, text): ranges of rising ids; each holds, as a halo, the row that follows its last one.

    Ids are cut at their approximate quantiles, and between these evenly; a table of one row for each range says where it begins.
    """
    key = F.col(id_col).cast("long")
    known = docs.select(key.alias("doc_id")).dropna()
    shares = [i / RANGES for i in range(RANGES)]
    found = known.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", shares, 10_000).alias("bounds"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    bounds = sorted({found.least, *found.bounds}) if found.n else [0]
    fine = min(FINE, found.n // (RANGES * ROWS) + 1)
    tops = [*bounds[1:], (found.most if found.n else 0) + 1]
    coarse = lambda of: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= of))

    def bucket(of: Column) -> Column:
        low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), coarse(of)) for xs in (bounds, tops))
        share = F.when(high > low, (of.cast("double") - low) / (high - low)).otherwise(0.0)
        return (coarse(of).cast("bigint") - 1) * fine + F.least(F.floor(share * fine), F.lit(fine - 1))

    firsts = known.select(bucket(F.col("doc_id")).alias("bucket"), "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("first"))
    around = Window.orderBy("bucket")  # RANGES * FINE rows at most
    last = F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(around), last).alias("before"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(RANGES))).otherwise(bucket(F.col("doc_id"))))
    own, halo = F.struct("bucket", F.lit(0).alias("halo")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("halo"))
    places = F.when(F.col("doc_id") == F.col("first"), F.array(own, halo)).otherwise(F.array(own))
    # the broadcast side has RANGES * FINE rows of 24 bytes at most: 25 MB
    return rows.join(F.broadcast(firsts), "bucket", "left").select("doc_id", "text", F.inline(places))


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: the edited text's hash, the digests of the text (a), the edited text (e) and the next one (b), both fingerprints and what these alone tell."""
    order = Window.partitionBy("bucket").orderBy("halo", "doc_id", "text")
    rows = _ordered(docs, id_col, text_col).withColumn("next", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4)
    edited = F.concat(F.substring("text", F.lit(1), (n - quarter).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter.cast("int")))
    rows = rows.select("bucket", "halo", "doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("bucket", "halo", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"))
    rows = rows.select("*", sketch(F.col("a")).alias("ca"), sketch(F.col("e")).alias("ce"))
    known = F.col("doc_id").isNotNull()
    rows = rows.select("*", F.when(known, F.lead("a").over(order)).alias("b"), F.when(known, F.lead("ca").over(order)).alias("cb")).filter("halo = 0")
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.size("a"), F.col("ca")).alias("fingerprint"),
        to_text(F.size("e"), F.col("ce")).alias("edited_fingerprint"),
        "a",
        "e",
        "b",
        peel(subtract(F.col("ca"), F.col("ce")), 0).alias("to_edited"),
        F.when(F.col("b").isNotNull(), peel(subtract(F.col("ca"), F.col("cb")), 0)).alias("to_next"),
    )


def _retried(pairs: DataFrame, again: int) -> DataFrame:
    """(pair, done, mine, other) of pairs of digest sets (a, o), with larger tables at each further try."""
    blocks = (F.floor((F.size("a") + F.size("o")) / LOAD) + 1) * 4 ** (again - 1)
    signed = F.concat(F.transform("a", lambda x: F.struct(x.alias("x"), F.lit(1).alias("s"))), F.transform("o", lambda x: F.struct(x.alias("x"), F.lit(-1).alias("s"))))
    # all that follows is grouped by keys that begin with pair: one shuffle, of digests
    each = pairs.repartition("pair").select("pair", blocks.alias("blocks"), F.inline(signed))
    each = each.select("*", F.xxhash64("x", F.lit(again)).alias("h"))
    each = each.select("pair", "x", "s", F.pmod(F.shiftright("h", 32), F.col("blocks")).alias("block"), F.explode(F.array(*[_slot(F.col("h"), t) for t in range(TABLES)])).alias("cell"))
    cells = each.groupBy("pair", "block", "cell").agg(F.sum("s").alias("n"), F.bit_xor("x").alias("key"), F.bit_xor(_mark(F.col("x"))).alias("mark"))
    held = cells.groupBy("pair", "block").agg(F.collect_list(F.when((F.col("n") != 0) | (F.col("key") != 0) | (F.col("mark") != 0), F.struct("cell", "n", "key", "mark"))).alias("cells"))
    told = held.select("pair", peel(F.col("cells"), again, F.size("cells")).alias("d"))
    return told.groupBy("pair").agg(F.every("d.done").alias("done"), F.sum("d.mine").alias("mine"), F.sum("d.other").alias("other"))


def version_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of their edited versions, and how alike they and the next documents are.

    The edited text is the text with its last floor(n / 4) code points replaced by the first as many (or all) of the document with the next larger id (after
    the last: the first). Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``: shared
    distinct paragraphs among all of both texts, counted by subtracting and peeling; 1 for two texts without any.

    A null text is an empty one. Rows that repeat an id follow one another in the order of their texts. A row with a null id is nobody's next and has none: its edited text only
    lacks the last quarter, its ``near_next`` is null. Very long texts are read whole; a paragraph that a text repeats counts once. A lone row is its own next.
    No rows give no rows. Other columns aren't read.
    """
    base = stored(_versions(docs, id_col, text_col), "versions")
    pair = lambda k, o, told: F.struct((F.col("row") * 2 + k).alias("pair"), F.col("a"), F.col(o).alias("o"), F.col(f"{told}.done").alias("done"))
    left = base.select(F.inline(F.array(pair(0, "e", "to_edited"), pair(1, "b", "to_next")))).filter("not done").drop("done")
    found = []
    for again in range(1, MAX_TRIES):
        told = stored(_retried(left, again), "peeled")
        found.append(told.filter("done"))
        failed = told.filter("not done").select("pair")
        if failed.isEmpty():
            break
        left = stored(left.join(failed, "pair", "left_semi"), "retries")
    else:
        raise RuntimeError("digests that no table tells apart")
    more = reduce(DataFrame.unionByName, found)
    which = lambda k: F.max(F.when(F.col("pair") % 2 == k, F.struct("mine", "other")))
    more = more.groupBy(F.floor(F.col("pair") / 2).alias("row")).agg(which(0).alias("edited"), which(1).alias("next"))
    n = F.size("a").cast("bigint")
    near = lambda told, later: likeness(n, F.when(F.col(f"{told}.done"), F.col(f"{told}.mine")).otherwise(F.col(f"{later}.mine")), F.when(F.col(f"{told}.done"), F.col(f"{told}.other")).otherwise(F.col(f"{later}.other")))
    few = base.select("row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "to_edited", "to_next", n.alias("_n"))
    n = F.col("_n")
    return few.join(more, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("to_edited", "edited").alias("near_edited"), near("to_next", "next").alias("near_next")
    )
