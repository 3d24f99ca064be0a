"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import collections
import random
import re
from zlib import crc32

import pytest

from engram.llm import variants

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows, least, every):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if o != w and near(w, o))
        leads = bool(others) and -others[0][0] >= ratio * n
        out[w] = (others[0][1] if leads else None, n, len(others), -others[0][0] if leads else None)
    final = {}
    for w, (form, n, n_near, form_n) in out.items():
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        final[w] = (form, end, n, n_near, form_n)
    return final


def texts():
    rnd = random.Random(7)
    stems = ["straße", "aaaaaa", "aabbaa", "kitten", "NAÏVETÉ", "mitten", "overflow", "ÿÿÿÿÿÿ", "ab"]
    words = []
    for stem in stems:
        words += [stem] * rnd.choice([1, 9, 60])
        for _ in range(25):
            w, i, c = stem, rnd.randrange(len(stem)), rnd.choice("abké")
            w = rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + w[i] + w[i:]])
            words += [w] * rnd.choice([1, 2, 6, 12])
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i * 20:(i + 1) * 20]) + rnd.choice([".", "\n", "-x1y"])) for i in range(len(words) // 20 + 1)]
    long = " ".join(rnd.choice(words) for _ in range(4_000))
    return [*rows, (9_001, long), (9_001, long), (None, "kitten's sitting"), (None, None), (5, ""), (6, "× ÷ 123 _"), (7, "x" * 30_000)]


@pytest.mark.parametrize(("least", "every"), [(6, 19), (1, None)])
def test_words_are_counted_whole(spark, least, every):
    rows = texts()
    docs = spark.createDataFrame([(*r, -1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in variants.word_counts(docs, "doc_id", "text", least, every).collect()}
    assert got == counted(rows, least, every)


@pytest.mark.parametrize("ratio", [2, 5])
def test_groups_equal_all_pairs(spark, ratio):
    counts = {w: n for w, n in counted(texts(), 3, 19).items() if n >= 2}
    words = spark.createDataFrame([(w, n, "extra") for w, n in counts.items()], "word string, n long, form string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_groups(words, ratio).collect()}
    assert got == grouped(counts, ratio)
    assert sum(v[0] is not None for v in got.values()) > 10


def test_chains_of_forms_are_followed_to_the_end(spark):
    counts = {"abcdefgh"[:i] + "z" * (9 - i): 6 ** i for i in range(1, 9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in variants.spelling_groups(words, 5).collect()}
    assert got == {w: v[1] for w, v in grouped(counts, 5).items()} and len(set(got.values())) == 1


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.word_counts(none, "doc_id", "text").collect() == []
    assert variants.spelling_groups(variants.word_counts(none, "doc_id", "text")).collect() == []
    odd = spark.createDataFrame([(None, 4), ("a\x00b", 2), ("lonely", 3)], "word string, n long")
    assert [tuple(r) for r in variants.spelling_groups(odd).collect()] == [("lonely", None, "lonely", 3, 0, None)]


def test_a_group_is_never_larger_than_the_alphabet(spark):
    """Every word one replacement away from every other: 26 members share one prefix."""
    words = spark.createDataFrame([(c + "elling", 10 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "word string, n long")
    got = variants.spelling_groups(words, 2).collect()
    assert {r.n_near for r in got} == {25}
    most = variants.rotations(words).groupBy("prefix").count().agg({"count": "max"}).first()[0]
    assert most == 26
