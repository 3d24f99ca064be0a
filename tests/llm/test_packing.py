"""Packing: ids against the tokenizer itself, pieces put together again, limits, padding and the choice of pieces."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from engram.llm import catalog, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "one", "It's they'RE we'LL 'tis o'clock 's", "!'s ''s don''t", "<|endoftext|> is <|startoftext|>text", "Über naïve ÀÉ × ÷ ß é ́x",
         "ΑΣ ΣΑΣ İstanbul ǅ", "12 3a4 a1b2 ½ ² 一二三 日本語text", "a b c\x1cd\x85e", "😀😀 a😀b — “quoted” it’s", "x" * 9_000, "word " * 9_000, "\x00 null \x7f", "a_b-c.d,e;f", "a.b-é" * 40_000 + " ж"]


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.array([*e.ids, 2], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer():
    rnd = random.Random(1)
    c = packing.WordCodec(PATH)
    mixed = ["".join(rnd.choice(["a", "É", "é", "'", "s", "LL", " ", "\n", " ", "7", "-", "Σ", "́", "ж", "'re"]) for _ in range(60)) for _ in range(400)]
    for text, want in zip(TEXTS + mixed, encoded(TEXTS + mixed)):
        assert (c.encode(text or "") + b"\x02\0\0\0") == want, text


def whole_again(rows, limits):
    """Checks the sequences of rows (key, start, length, ids, n, sequence, offset) and gives the bytes of each example."""
    tokens, segments = limits
    sequences, examples = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r[5]].append(r)
        examples[r[0]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r[6])
        ends = np.cumsum([0] + [r[2] for r in pieces]).tolist()
        assert [r[6] for r in pieces] == ends[:-1] and len(pieces) <= segments
        assert ends[-1] == tokens or (ends[-1] <= tokens and ends[-1] & (ends[-1] - 1) == 0)
    out = {}
    for key, pieces in examples.items():
        pieces.sort(key=lambda r: r[1])
        assert [r[1] for r in pieces] == np.cumsum([0] + [r[2] for r in pieces]).tolist()[:-1]
        out[key] = b"".join(r[3] for r in pieces)
        assert all(len(out[key]) == 4 * r[4] and len(r[3]) == 4 * r[2] for r in pieces)
    return out


def test_documents_are_packed_whole(spark):
    docs = spark.createDataFrame([(i, t, -1, -1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, start int").repartition(2)
    rows = [tuple(r) for r in packing.pack(packing.with_ids(docs, PATH), "doc_id", tokens=512, segments=5, loss=512).collect()]
    assert whole_again(rows, (512, 5)) == dict(enumerate(encoded(TEXTS)))


def test_rows_that_share_a_key_and_rows_without_one_are_examples(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(packing.with_ids(docs, PATH), "doc_id").collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1), (0, 2), (1, 4), (1, 4)]
    assert sum(r.length for r in rows) == 11


def test_no_rows_and_no_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.with_ids(empty, PATH), "doc_id").collect() == []
    assert packing.pack(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), "doc_id").collect() == []


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 64, 20), (32, 1, 32), (100, 3, 7), (1, 1, 1)])
def test_instruction_data_keeps_all_three_limits(spark, limits):
    tokens, segments, loss = limits
    rnd = random.Random(tokens + loss)
    rows = []
    for i in range(300):
        n = rnd.choice([1, 2, 3, 20, 60, 200])
        rows.append((i, np.arange(1000 * i, 1000 * i + n).astype("<u4").tobytes(), rnd.choice([None, 0, n // 2, n])))
    examples = spark.createDataFrame(rows, "doc_id long, ids binary, prompt long").repartition(3)
    got = [tuple(r) for r in packing.pack(examples, "doc_id", prompt="prompt", tokens=tokens, segments=segments, loss=loss).collect()]
    assert whole_again(got, (tokens, segments)) == {i: data for i, data, _ in rows}
    fronts, bearing = {i: p or 0 for i, _, p in rows}, collections.Counter()
    for key, start, length, _, _, sequence, _ in got:
        bearing[sequence] += sum(t >= fronts[key] for t in range(start, start + length))
    assert max(bearing.values()) <= loss


def test_the_choice_is_the_largest_dot_product():
    """Against a plain loop over the pool."""
    rnd = random.Random(2)
    for _ in range(30):
        limits = (100, 6, 60)
        pool, pieces = packing.Pool(limits), []
        for i in range(40):
            n = rnd.randint(1, 60)
            pieces.append((i, 0, n, rnd.randint(0, n)))
        pool.put(list(pieces))
        asks = {p: (p[2], 1, p[2] - p[3]) for p in pieces}
        weights = [sum(a[d] for a in asks.values()) / len(asks) / limits[d] ** 2 for d in range(3)]
        left, want, waiting = list(limits), [], list(pieces)
        while left[0] and left[1]:
            def worth(p):
                return sum(asks[p][d] * weights[d] * left[d] for d in range(3))
            fits = [p for p in waiting if all(asks[p][d] <= left[d] for d in range(3))]
            if not fits or left[1] == 1:
                break
            best = max(fits, key=worth)
            want.append((best[0], 0, best[2]))
            waiting.remove(best)
            left = [left[d] - asks[best][d] for d in range(3)]
        got = pool.sequence()
        assert got[:len(want)] == want and len(got) - len(want) <= 6


def test_sequences_that_are_not_full_become_powers_of_two():
    parts = packing.powers([(0, 0, 5), (1, 3, 6)], 64)
    assert parts == [[(0, 0, 5), (1, 3, 3)], [(1, 6, 2)], [(1, 8, 1)]]
    assert packing.powers([(0, 0, 64)], 64) == [[(0, 0, 64)]]


def test_registered_query_matches_the_tokenizer(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    ids = dict(zip(texts, encoded(texts.values())))
    covered = collections.Counter()
    for r in catalog.QUERIES["op13_vector_bin_packing"](spark, sf_dir).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start:4 * (r.start + r.length)])
        covered[r.doc_id] += r.length
    assert {k: 4 * v for k, v in covered.items()} == {k: len(v) for k, v in ids.items()}
