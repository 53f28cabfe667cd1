"""Exact search for a stated set of queries: dense vectors by blocks, and BM25 by bounds.

Dense: queries come in blocks of bounded size. A block meets every partition of the vectors as matrix products over Arrow
batches; a partition keeps the best of each query only, and these are merged by query. No pair leaves a task unless it is
among a partition's best.

Lexical: one pass over the texts counts each term's documents and keeps, of each document, the terms that some query has. A term's largest gain
bounds what it can add. Rare terms give each query a score that its k-th document surely reaches; documents that hold only terms whose bounds sum
to less can't be among the first k, so common terms never pair documents with queries. Documents are scored where they are; a task hands on
its best of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.sources.shared import give_back, saved

K1, B, EPSILON = 1.5, 0.75, 0.25  # Okapi's usual parameters
BLOCK_BYTES = 32 << 20  # of query vectors that meet the others at a time
TEXT = 1 << 20  # bytes of texts that are split at a time
DOCS = 512  # documents that are scored at a time
PRODUCT = 1 << 19  # cosines held at a time
BLOCK_TERMS = 200_000  # (query, term) rows of the queries that meet the texts at a time
SEED_DOCS = 2_000  # documents of the rare terms that a query's first bound is taken from, or those of its rarest term
SLACK = 1e-5  # more than rounding can change


def _blocks(queries: DataFrame, key: str, size: Column, limit: int) -> Iterator[DataFrame]:
    """The queries in parts whose ``size`` sums to about ``limit``."""
    total = queries.agg(F.sum(size)).first()[0] or 0
    n = -(-int(total) // limit)
    for i in range(n):
        yield queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else queries


def _usable(vector: str) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class _Best:
    """The best vectors of each query and group so far: by score rounded to six places, then by smaller id."""

    def __init__(self, n: int, top: int):
        self.n, self.top, self.groups = n, top, {}
        self.least = np.full((n, 0), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, groups: list) -> None:
        """``scores``: one row for each query, one column for each vector."""
        for g in groups:
            self.groups.setdefault(g, len(self.groups))
        if len(self.groups) > self.least.shape[1]:
            self.least = np.pad(self.least, ((0, 0), (0, len(self.groups) - self.least.shape[1])), constant_values=-np.inf)
        codes = np.array([self.groups[g] for g in groups], np.int64)
        query, vector = np.nonzero(scores >= self.least[:, codes])
        self.push(query, codes[vector], scores[query, vector], ids[vector])

    def push(self, query: np.ndarray, codes: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((query, codes, scores, ids))
        self.size += len(query)
        if self.size > max(PRODUCT, 4 * self.n * self.top * len(self.groups)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        query, group, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((ids, -score, group, query))
        query, group, score, ids = (x[order] for x in (query, group, score, ids))
        new = np.append(True, (query[1:] != query[:-1]) | (group[1:] != group[:-1]))[: len(query)]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        full = place == self.top - 1
        self.least[query[full], group[full]] = score[full]
        keep = place < self.top
        self.parts = [tuple(x[keep] for x in (query, group, score, ids))]
        self.size = int(keep.sum())
        return self.parts[0]


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, within: str | None = None) -> DataFrame:
    """The ``top`` vectors (vec_id, embedding) by cosine for each query (query_id, query_vector), of all vectors but that of the query's own id.

    With ``within``, a column of the vectors, the ``top`` of each of its values. Scores have six places; equal ones go by smaller id. A vector of
    length zero has the cosine 0. Vectors that are null or empty, or hold null or no finite number, take no part, nor do those of another length than the query's.
    Query ids are unique; a vector that repeats counts each time. Null ids take no part.
    """
    group = F.col(within).cast("string") if within else F.lit(None).cast("string")
    rows = vectors.filter(_usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), group.alias("g"))
    asked = queries.filter(_usable("query_vector") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("v"))
    found = None
    for block in _blocks(asked, "query_id", F.size("v") * 8, BLOCK_BYTES):
        part = _block_nearest(rows, block, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, g string, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select("query_id", *([F.col("g").alias(within)] if within else []), "vec_id", "score", "rank")


def _block_nearest(rows: DataFrame, block: DataFrame, top: int) -> DataFrame:
    table = block.toArrow()  # of BLOCK_BYTES or a little more
    held = rows.sparkSession.sparkContext.broadcast([(i, np.array(v)) for i, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)])

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(size == 0, 1.0, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[np.ndarray, np.ndarray, _Best]] = {}
        for size in {len(v) for _, v in held.value if len(v)}:
            some = [(i, v) for i, v in held.value if len(v) == size]
            by_size[size] = (np.array([i for i, _ in some]), unit(np.stack([v for _, v in some])), _Best(len(some), top))
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for size, (names, asked, best) in by_size.items():
                own = batch.filter(pa.array(sizes == size))
                step = max(1, PRODUCT // len(names))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    ids = part.column(0).to_numpy()
                    m = part.column(1).flatten().to_numpy().reshape(part.num_rows, size)
                    scores = np.round(asked @ unit(m).T, 6)
                    scores[names[:, None] == ids] = np.nan  # a query isn't its own neighbour
                    best.add(scores, ids, part.column(2).to_pylist())
        for names, _, best in by_size.values():
            query, group, score, ids = best.settle()
            give_back()
            labels = pa.array(list(best.groups), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), labels.take(pa.array(group)), pa.array(score, pa.float64()), pa.array(ids, pa.int64())], names=["query_id", "g", "score", "vec_id"])

    return rows.mapInArrow(run, "query_id long, g string, score double, vec_id long")


# ---- lexical ---------------------------------------------------------------------------------------------------


def _counted(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (lower case, parted by white space) of some texts; then row, term and times of each (row, term) in order, and each row's terms."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_string()), r"[ \t\n\x0b\x0c\r]+")
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    row = row.filter(real).to_numpy()
    key = np.sort((row.astype(np.int64) << 32) | coded.indices.to_numpy().astype(np.int64))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.diff(np.append(first, len(key)))
    return coded.dictionary, key[first] >> 32, key[first] & 0xFFFFFFFF, times, np.bincount(row, minlength=len(column)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with TEXT bytes of text or so, or with one long text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT, prepend=-1, append=-1))
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(at, end - at)


_SEEN = "kind int, doc_id long, dl long, term string, n long, terms array<struct<term:string,tf:long>>"
_TOTAL, _TERM, _DOC = 0, 1, 2


def _seen(docs: DataFrame, doc_id: str, vocabulary: pa.Array) -> DataFrame:
    """From one pass over the texts: documents and words (by task), documents of each term (by task), and each document's terms that are in ``vocabulary``."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a block of queries: BLOCK_TERMS at most

    def batch(kind: int, length: int, **given: pa.Array) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "doc_id": pa.int64(), "dl": pa.int64(), "term": pa.string(), "n": pa.int64(), "terms": pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))}
        given["kind"] = pa.array(np.full(length, kind, np.int32))
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(length, t)) for k, t in types.items()], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_n = words_n = size = 0
        parts: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"])

        for b in _slices(batches, 1):
            terms, row, code, times, dl = _counted(b.column(1))
            docs_n, words_n = docs_n + b.num_rows, words_n + int(dl.sum())
            parts.append(pa.table({"term": terms.cast(pa.string()), "n": np.bincount(code, minlength=len(terms)).astype(np.int64)}))
            size += len(terms)
            if size > BLOCK_TERMS:
                parts = [summed()]
                size = parts[0].num_rows
                if 2 * size > BLOCK_TERMS:
                    yield from (batch(_TERM, x.num_rows, term=x.column(0), n=x.column(1)) for x in parts[0].combine_chunks().to_batches())
                    parts, size = [], 0
            wanted = pc.is_in(terms, value_set=held.value.cast(terms.type)).to_numpy(zero_copy_only=False)[code]
            row, code, times = row[wanted], code[wanted], times[wanted]
            structs = pa.StructArray.from_arrays([terms.take(pa.array(code)).cast(pa.string()), pa.array(times.astype(np.int64))], names=["term", "tf"])
            full = np.unique(row)
            bounds = pa.array(np.append(np.searchsorted(row, full), len(row)).astype(np.int32))
            yield batch(_DOC, len(full), doc_id=b.column(0).take(pa.array(full)), dl=pa.array(dl[full]), terms=pa.ListArray.from_arrays(bounds, structs))
        if parts:
            yield from (batch(_TERM, x.num_rows, term=x.column(0), n=x.column(1)) for x in summed().combine_chunks().to_batches())
        yield batch(_TOTAL, 1, dl=pa.array([words_n]), n=pa.array([docs_n]))
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SEEN)


def _asked_terms(queries: DataFrame, query_id: str) -> DataFrame:
    """(query_id, term, times) of the queries' texts, split as documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            terms, row, code, times, _ = _counted(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), terms.take(pa.array(code)).cast(pa.string()), pa.array(times.astype(np.int64))], names=["query_id", "term", "times"])

    split = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col("text").cast("string")).mapInArrow(run, "query_id long, term string, times long")
    return split.groupBy("query_id", "term").agg(F.sum("times").alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, top: int = 5, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """The ``top`` documents of each query by Okapi BM25; a term's idf below zero becomes a quarter of the mean idf.

    Both have a text column; terms are lower-case words parted by white space. Scores have six places, equal ones go by smaller id; documents without a
    term of the query aren't found. Texts that are null or empty have no terms but count as documents. Ids are unique; rows with a null id count as documents and aren't found.
    """
    asked = saved(_asked_terms(queries.filter(F.col(query_id).isNotNull()), query_id), "asked")
    found = None
    for block in _blocks(asked.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", F.col("n"), BLOCK_TERMS):
        part = _block_bm25(docs, asked.join(block.select("query_id"), "query_id"), top, doc_id)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return found.select(F.col("query_id").alias(query_id), F.col("doc_id").alias(doc_id), "score", "rank")


class _Weights:
    """The terms of a block of queries: weights, and which terms bring a document into question."""

    def __init__(self, queries: np.ndarray, vocabulary: pa.Array, query: np.ndarray, code: np.ndarray, weight: np.ndarray, needed: np.ndarray):
        self.queries, self.vocabulary = queries, vocabulary
        order = np.lexsort((code, query))
        self.key, self.weight = query[order] * len(vocabulary) + code[order], weight[order]
        by_code = np.argsort(code[needed], kind="stable")
        self.needing = query[needed][by_code]
        self.starts = np.searchsorted(code[needed][by_code], np.arange(len(vocabulary) + 1))


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its size says, and the place within its own run."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _scored(forward: DataFrame, weights: _Weights, mean: float, top: int) -> DataFrame:
    """(query_id, doc_id, score): each task's best documents of each query, of those that hold a needed term."""
    held = forward.sparkSession.sparkContext.broadcast(weights)  # BLOCK_TERMS rows at most, or one query's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        n = len(w.vocabulary)
        best = _Best(len(w.queries), top)
        best.groups, best.least = {None: 0}, np.full((len(w.queries), 1), -np.inf)
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            terms = batch.column(2).flatten()
            code = pc.index_in(terms.field("term"), value_set=w.vocabulary).to_numpy()
            bounds = batch.column(2).offsets.to_numpy()
            bounds = bounds - bounds[0]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            tf, dl = terms.field("tf").to_numpy(), batch.column(1).to_numpy()[doc]
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            ids = batch.column(0).to_numpy()
            which, place = _spread(w.starts[code + 1] - w.starts[code])
            pairs = np.unique(doc[which] * len(w.queries) + w.needing[w.starts[code[which]] + place])
            pair_doc, pair_query = pairs // len(w.queries), pairs % len(w.queries)
            for at in range(0, len(pairs), 1 << 14):
                d, q = pair_doc[at : at + (1 << 14)], pair_query[at : at + (1 << 14)]
                which, place = _spread(np.diff(bounds)[d])
                posting = bounds[d][which] + place
                key = q[which] * n + code[posting]
                found = np.minimum(np.searchsorted(w.key, key), len(w.key) - 1)
                score = np.bincount(which, np.where(w.key[found] == key, w.weight[found] * gain[posting], 0.0), len(d))
                score = np.round(score, 6)
                good = score >= best.least[q, 0]
                best.push(q[good], np.zeros(int(good.sum()), np.int64), score[good], ids[d[good]])
        query, _, score, ids = best.settle()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(w.queries[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])

    return forward.mapInArrow(run, "query_id long, doc_id long, score double")


def _block_bm25(docs: DataFrame, asked: DataFrame, top: int, doc_id: str) -> DataFrame:
    vocabulary = asked.select("term").distinct().toArrow().column(0).combine_chunks()
    seen = saved(_seen(docs, doc_id, vocabulary), "terms")
    n, words = seen.filter(F.col("kind") == _TOTAL).agg(F.sum("n"), F.sum("dl")).first()
    none = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if not words:
        return none
    forward = seen.filter((F.col("kind") == _DOC) & F.col("doc_id").isNotNull()).select("doc_id", "dl", "terms")
    dfs = seen.filter(F.col("kind") == _TERM).groupBy("term").agg(F.sum("n").alias("df"))
    raw = dfs.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg(F.avg("raw")).first()[0] * EPSILON
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(words / n)))
    bounds = forward.select("dl", F.inline("terms")).groupBy("term").agg(F.max(gain).alias("most"))
    told = raw.join(asked, "term").join(bounds, "term").toArrow().combine_chunks()  # BLOCK_TERMS rows at most, or one query's
    if not told.num_rows:
        return none
    names, query = np.unique(told.column("query_id").to_numpy(), return_inverse=True)
    code = pc.index_in(told.column("term").combine_chunks(), value_set=vocabulary).to_numpy()
    idf = told.column("raw").to_numpy()
    weight = told.column("times").to_numpy() * np.where(idf < 0, floor, idf)
    bound = np.maximum(0.0, weight * told.column("most").to_numpy())

    order = np.lexsort((code, -bound, query))
    query, code, weight, bound, df = (x[order] for x in (query, code, weight, bound, told.column("df").to_numpy()))
    first = np.append(True, query[1:] != query[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    upto = np.cumsum(df) - (np.cumsum(df) - df)[start]
    sums = np.append(0.0, np.cumsum(bound))
    end = np.append(np.flatnonzero(first)[1:], len(query))[query]
    rest = sums[end] - sums[np.arange(len(query))]  # the bounds of this term and those behind it

    # what the k-th document of each query reaches by its rare terms alone; nothing is known where a weight is below zero
    seeds = ((upto <= SEED_DOCS) | first) & (np.bincount(query, weight < 0)[query] == 0)
    reached = np.full(len(names), -np.inf)
    if seeds.any():
        partial = _scored(forward, _Weights(names, vocabulary, query[seeds], code[seeds], weight[seeds], np.ones(int(seeds.sum()), bool)), words / n, top)
        kth = best(partial, "query_id", "doc_id", top).filter(F.col("rank") == top).select("query_id", "score").toArrow()  # one row a query
        reached[np.searchsorted(names, kth.column(0).to_numpy())] = kth.column(1).to_numpy()
    found = _scored(forward, _Weights(names, vocabulary, query, code, weight, rest >= reached[query] - SLACK), words / n, top)
    return best(found, "query_id", "doc_id", top)


def best(scores: DataFrame, query_id: str, doc_id: str, top: int) -> DataFrame:
    """The ``top`` rows of each query by score, then by smaller id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top)


# ---- both ------------------------------------------------------------------------------------------------------


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; 0 without any. A stand-in for a model that scores pairs."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), ""))
    return F.when(F.size(words(query)) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(words(query), words(text))) / F.size(words(query)), 6))


def hybrid_search(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, *, dense_top: int = 10, lexical_top: int = 5, top: int = 3, threshold: float = 0.0, relevance=coverage, joint: str = "\n\n---\n\n"
) -> DataFrame:
    """For each query (query_id, text, query_vector) the candidates of dense and lexical search, each text once, ranked by ``relevance``, from ``threshold`` on: the ``top`` texts, joined.

    docs: doc_id, text; vectors: vec_id (a document's id), embedding. Of equal texts the smallest id stands for all. A query that nothing passes gets an empty
    context and n = 0. A vector whose document isn't there gives no candidate.
    """
    dense = nearest(vectors, queries, dense_top).select("query_id", F.col("vec_id").alias("doc_id"))
    lexical = bm25(docs, queries.select("query_id", "text"), lexical_top).select("query_id", "doc_id")
    candidates = dense.unionByName(lexical).distinct()
    asked = queries.select("query_id", F.col("text").alias("_asked"))
    met = candidates.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id", "text").agg(F.min("doc_id").alias("doc_id")).join(asked, "query_id")
    scored = met.withColumn("score", relevance(F.col("_asked"), F.col("text"))).filter(F.col("score") >= threshold)
    ranked = best(scored.select("query_id", "doc_id", "text", "score"), "query_id", "doc_id", top)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "doc_id")))
    told = ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), joint).alias("context"), F.transform(ordered, lambda x: x["doc_id"]).alias("doc_ids"))
    nothing = F.array().cast("array<bigint>")
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("doc_ids", nothing).alias("doc_ids"), F.size(F.coalesce("doc_ids", nothing)).alias("n"))
