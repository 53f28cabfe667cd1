"""The alignment of two tokenizers against token by token comparison with their libraries."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltmarsh.llm import token_alignment as ta

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FIRST, SECOND = (open(p, "rb").read() for p in (ta.BYTE_LEVEL, ta.MODEL))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_str(FIRST.decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=SECOND)


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 400))
    return {(chr(b) if b in plain else chr(next(rest))): b for b in range(256)}


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def one(text, a, b, letters):
    """Ids, link places and groups of a text; nothing if it has no tokens."""
    whole = (" " + (text or "")).encode()
    e = a.encode(" " + (text or ""), add_special_tokens=False)
    bytes_a = [bytes(letters[c] for c in t) for t in e.tokens]
    ids_b = b.encode(text or "")
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    both = sorted(set(ends_a) & set(ends_b))
    links = [(e.ids[ends_a.index(x)], ids_b[ends_b.index(x)]) for x in both]
    groups, low = [], 0
    for x in both:
        groups.append((low, x, [i for i, y in zip(e.ids, ends_a, strict=True) if low < y <= x], [i for i, y in zip(ids_b, ends_b, strict=True) if low < y <= x]))
        low = x
    return e.ids, ids_b, links, groups


def brute(rows, libraries):
    letters = byte_letters()
    found = [(d, *one(t, *libraries, letters)) for d, t, *_ in rows]
    counts = Counter(x for _, _, _, links, _ in found for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d, ids_a, ids_b, links, groups in found:
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((d, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr), counts, found


def some_texts(rng, n):
    pool = [" ", "  ", "\n", "\t", "the", "The", "ing", "été", "漢字", "1234", "<|endoftext|>", "<s>", "▁", "don't", "!", "🙂", "\x00", "́", "ǅ", "<0x41>", " ", " "]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_against_token_by_token(spark, libraries, seed, monkeypatch):
    monkeypatch.setattr(ta, "SLICE", 500)
    rng = random.Random(seed)
    texts = [*some_texts(rng, 80), None, "", " ", "a" * 5000, " " * 3000 + "x", "the the the " * 400]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want, counts, found = brute(rows, libraries)
    got = ta.alignment_counts(df, FIRST, SECOND).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {(r.a_id, r.b_id): r.n for r in ta.pair_counts(df, FIRST, SECOND).collect()} == counts
    groups = {r.doc_id: [(g.start, g.end, g.a_ids, g.b_ids) for g in r.groups] for r in ta.token_groups(df.filter("doc_id is not null"), FIRST, SECOND).collect()}
    assert groups == {d: g for d, _, _, _, g in found if d is not None}


def test_counts_handed_on_early_and_few_buckets(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "SLICE", 300)
    rng = random.Random(4)
    rows = [(i, t, None, None, None) for i, t in enumerate(some_texts(rng, 300))]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    want, _, _ = brute(rows, libraries)
    assert sorted((tuple(r) for r in ta.alignment_counts(df, FIRST, SECOND).collect()), key=repr) == want


def test_no_rows_and_further_columns(spark, libraries):
    assert ta.alignment_counts(spark.createDataFrame([], DOCS), FIRST, SECOND).count() == 0
    rows = [(1, "two words", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "kind", "pair", "bucket", "n", "data", "salt", "n_a", "groups"):
        df = df.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in ta.alignment_counts(df, FIRST, SECOND).collect()] == brute(rows, libraries)[0]
    assert [tuple(r) for r in ta.alignment_counts(spark.createDataFrame([(1, None, None, None, None)], DOCS), FIRST, SECOND).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_both_libraries_give_equal_ids():
    level = ta.ByteLevel(FIRST)
    assert level.fast is not None
    texts = [f" x{c}y1{c}{c} {c}!{c} {c} \n{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)])]
    assert level.encode(texts) == [e.ids for e in level.slow.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_files_go_through_the_tokenizers_library():
    said = json.loads(FIRST)
    said["pre_tokenizer"]["add_prefix_space"] = True
    assert ta.ByteLevel(json.dumps(said).encode()).fast is None
