"""Packing against the tokenizers library and an item-by-item model of the sum-of-squares rule."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe, pack
from evidentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, size):
    """Rows of (doc_id, piece, start, length, ids_crc32, sequence_id, offset) against the library; texts by id, with repeats."""
    want, tokenizer = [], library()
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        for piece, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start : first if piece == 0 else start + size]
            want.append((key, piece, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r[5]].append((r[6], r[3]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held), sum(w[3] for w in want)


def test_query_packs_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in QUERIES["op13_packing"](spark, SF).collect()]
    n, tokens = check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 2048)
    assert n <= -(-tokens // 2048) + 2


TEXTS = [(1, "some words"), (1, "some words"), (2, None), (3, ""), (None, "no id, café 東京 \U0001f600"), (4, "a " * 300), (5, "<|endoftext|>in<|endoftext|> text"), (6, "x" * 5000), (7, "é" * 90)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 2048])
def test_null_empty_long_and_repeated_rows(spark, size):
    rows = [(k, t, "extra") for k, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sequence_id string").repartition(3)
    got = pack.pack(docs, VOCABULARY, size)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check([tuple(r) for r in got.collect()], TEXTS, size)
    assert pack.pack(docs.limit(0), VOCABULARY, size).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    packed = pack.pack(docs, VOCABULARY, 64, with_ids=True)
    whole = {r["sequence_id"]: r for r in pack.sequences(packed).collect()}
    pieces = packed.collect()
    assert len(whole) == len({r["sequence_id"] for r in pieces})
    for r in pieces:
        s = whole[r["sequence_id"]]
        assert s["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert (r["offset"], r["length"], r["doc_id"], r["piece"]) in [tuple(p) for p in s["pieces"]]


def one_by_one(items, size):
    """Sum of squares with every sum worked out anew: the bins as lists of lengths."""
    bins = []
    for s in sorted(items, reverse=True):
        gaps = Counter(size - sum(b) for b in bins)
        options = []
        for g in gaps:
            if 0 < g and g >= s:
                after = gaps.copy()
                after[g] -= 1
                after[g - s] += 1
                options.append((sum(n * n for x, n in after.items() if x > 0), g))
        if options:
            g = min(options)[1]
            next(b for b in bins if size - sum(b) == g).append(s)
        else:
            bins.append([s])
    return sorted(map(sum, bins))  # which of the bins of one gap an item goes to is free


def test_plan_is_the_rule_item_by_item():
    rng = np.random.default_rng(3)
    for size in (10, 33, 64):
        for _ in range(30):
            items = rng.integers(1, size, rng.integers(0, 40)).tolist()
            plan = pack.sum_of_squares(Counter(items), size, blocks=len(items) or 1)
            bins = defaultdict(list)
            for length, _, many, first, offset in sorted(plan.tolist(), key=lambda r: r[4]):
                for b in range(first, first + many):
                    assert sum(bins[b]) == offset
                    bins[b].append(length)
            assert sorted(map(sum, bins.values())) == one_by_one(items, size)


def test_blocks_lose_little():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6.2, 0.9, 200_000).astype(int) + 1, 2047)
    plan = pack.sum_of_squares(Counter(lengths.tolist()))
    used = int((plan[:, 3] + plan[:, 2]).max())
    assert plan[:, 2].sum() == len(lengths)
    assert used <= 1.002 * lengths.sum() / 2048 + 1


def test_merges_of_many_words():
    model = bpe.Bpe(json.loads(bpe.load_spec(VOCABULARY)))
    words = ["", " the", "a", "aaaaaaaaaaaa", "antidisestablishmentarianism", "x" * 200, " naïve", "東京都", "\n\n\n"]
    got = pack.PackedEncoder(model).encode(["".join(words[:1]), *words, " ".join(words)], 7)
    assert [g.tolist() for g in got] == [[i for w in model.words(t) for i in model.merge(w.encode())] + [7] for t in ["", *words, " ".join(words)]]
