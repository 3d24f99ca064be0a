"""Toxicity with noisy-channel deobfuscation.

A token that mixes letters with look-alikes, stretches a letter or is spelled with single characters becomes a lattice of
the characters that could be meant. Viterbi decoding under a character language model, counted over all documents, restores it;
then a linear model over hashed words and word beginnings scores the restored text. Other tokens have one path and stand for
themselves.

Null and empty texts get the score of a text without words. Rows are scored one by one: repeats, ties and very long texts
need no rule. Labels of null or unlabelled rows are ignored; without both labels every row gets the smoothed share. Other columns are
passed on; ``score`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from engram.llm.common import slices
from engram.llm.hashedtext import fit, sample, scorer

#: What a character may stand for, besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i",
              "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x", "&": "a"}
EDGE = " .,;:?\"'`´“”„«»)]}[{<>~^=\\/_-"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"
#: Symbols of the language model: a letter of the list, or 0 for anything else.
SYMBOLS = len(LETTERS) + 1
#: Cost of taking a look-alike, a stretched letter or a written non-letter, in nats.
LEET, STRETCH, LITERAL = 0.7, 0.7, 6.0

MIXED = re.compile(r"[^\W\d_]", re.UNICODE)
ALIKE = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
STRETCHED = re.compile(r"([^\W\d_])\1\1", re.UNICODE)
SPACED = re.compile(r"(?<![^\s])[^\s](?:[ .*_\-][^\s]){2,}(?![^\s])")
PARTED = re.compile(r"^\w(?:[.*_\-]\w){2,}$")


@cache
def symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
        if len(c.upper()) == 1 and ord(c.upper()) < 0x250:
            table[ord(c.upper())] = i + 1
    return table


def language_model(docs: DataFrame, text: str) -> np.ndarray:
    """-log P(third | first two) of characters, from counts over all documents: a cube of bounded size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                points = np.frombuffer("\n".join([t or "" for t in batch.column("text").to_pylist()] + [""]).encode("utf-32-le"), np.uint32)
                s = table[np.where(points < 0x250, points, 0)]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    cube = np.zeros(SYMBOLS**3)
    cube[counts.column("code").to_numpy()] = counts.column("n").to_numpy()
    cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.01
    return -np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


def suspicious(token: str) -> bool:
    return bool(STRETCHED.search(token) or ALIKE.search(token) and MIXED.search(token))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character what it may stand for, and the cost of that reading."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        ways = [(c * run, 0.0)] if c.isalpha() else [(c * run, LITERAL * run)]
        for meant in [c] if c.isalpha() else LOOKS_LIKE.get(c, ""):
            cost = 0.0 if c.isalpha() else LEET
            if not c.isalpha():
                ways.append((meant * run, cost * run))
            if run > 2:
                ways += [(meant, cost + STRETCH), (meant * 2, cost + STRETCH)]
            elif run == 2 and not c.isalpha():
                ways.append((meant, cost + STRETCH))
        out.append(ways)
        i = j
    return out


def restore(token: str, model: np.ndarray) -> str:
    """The cheapest reading of a token under the language model, from blank to blank."""
    table = symbol_table()
    code = lambda c: int(table[ord(c)]) if ord(c) < 0x250 else 0
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for ways in [*lattice(token), [(" ", 0.0)]]:
        ahead: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for meant, extra in ways:
                x, y, total = a, b, cost + extra
                for c in meant:
                    z = code(c)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in ahead or (total, text + meant) < ahead[x, y]:
                    ahead[x, y] = (total, text + meant)
        states = ahead
    return min(states.values())[1].strip()


def word_of(token: str, model: np.ndarray) -> str:
    """The word a raw token stands for: bare of edges, in lower case, restored where it is suspicious."""
    word = token.lower().strip(EDGE)
    if PARTED.match(word):
        word = re.sub(r"[.*_\-]", "", word)
    bare = word.rstrip("!*+|(&%#€$£¡@")
    if bare and not suspicious(bare):
        return bare
    return restore(word, model) if suspicious(word) else word


def features_of(model: np.ndarray) -> Callable[[str], list[str]]:
    def features(token: str) -> list[str]:
        word = word_of(token, model)
        return ["w:" + word, *(f"p:{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if word else []
    return features


def tokens(text: str) -> tuple[set[str], set[str]]:
    """Distinct raw tokens, with words spelled by single characters in one piece."""
    found = set(text.split())
    for m in SPACED.finditer(text):
        found.add(re.sub(r"(.)[ .*_\-]", r"\1", m[0][:-1]) + m[0][-1])
    return found, set()


def with_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
                label_key: str = "doc_id", sampled: int = 8_000, out: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic label in ``out``; at most ``sampled`` labelled rows train it."""
    docs = docs.drop(out)
    model = language_model(docs, text)
    picked = F.broadcast(sample(labels, label_key, F.col(toxic), sampled))  # at most ``sampled`` rows of two numbers
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(picked, "key")
    weights, thresholds = fit(rows, "label", "text", lambda: tokens, lambda: features_of(model), 2, scaled=False, emphasis=3.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(weights, tokens, features_of(model), scaled=False)
        for whole in batches:
            for batch in slices(whole, text):
                values = np.array([score(t) for t in batch.column(text).to_pylist()]) - thresholds[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(values, -500, 500))))], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
