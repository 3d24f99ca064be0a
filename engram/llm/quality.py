"""Quality grades with ordinal cumulative-link regression.

One set of weights over hashed words, word shapes and facts about the whole text gives a score; ordered thresholds turn it into
P(grade > j) for each grade. From these come the expected grade and the tail probability, by which rows are selected.

Null and empty texts are graded as texts without words. Rows are graded one by one: repeats, ties and very long texts need no rule.
Ratings of null grades are ignored; without different ratings every row gets their smoothed shares. Other columns are passed
on; the three results replace columns of their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from engram.llm.common import slices
from engram.llm.hashedtext import fit, sample, scorer

SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))
FACT = "\0"


def tokens(text: str) -> tuple[set[str], set[str]]:
    """Distinct raw tokens, and facts about the whole text in coarse steps."""
    words = text.split()
    seen, n = Counter(words), max(1, len(words))
    lines = text.split("\n")
    chars = max(1, len(text))
    plain = sum(map(len, words)) / n
    shares = {
        "distinct": len(seen) / n, "top": max(seen.values(), default=0) / n, "upper": sum(1 for w in seen if len(w) > 1 and w.isupper()) / max(1, len(seen)),
        "odd": sum(1 for w in seen if not w[-1].isalnum() and w[-1] not in ".,") / max(1, len(seen)), "single": sum(1 for w in words if len(w) == 1) / n,
        "lines": len(set(lines)) / len(lines), "space": 1 - plain * n / chars}
    facts = {f"{FACT}{k}:{int(10 * v)}" for k, v in shares.items()} | {f"{FACT}words:{int(log2(n))}", f"{FACT}length:{int(min(20, plain))}"}
    return set(seen), facts


def features(token: str) -> list[str]:
    if token.startswith(FACT):
        return [token]
    shape = token
    for pattern, to in SHAPES:
        shape = pattern.sub(to, shape)
    return ["w:" + token.lower().strip(".,"), "s:" + shape[:12]]


def with_grades(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, key: str = "doc_id", text: str = "text", rating_key: str = "doc_id",
                least: int = 1, cut_off: float = 0.5, sampled: int = 8_000) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` = P(grade >= least) and ``kept`` where that reaches ``cut_off``.

    ``grade`` is an expression over ``ratings`` from 0 to ``grades`` - 1; at most ``sampled`` rated rows train the model.
    """
    docs = docs.drop("expected_grade", "tail_probability", "kept")
    picked = F.broadcast(sample(ratings, rating_key, grade, sampled))  # at most ``sampled`` rows of two numbers
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(picked, "key")
    weights, thresholds = fit(rows, "label", "text", lambda: tokens, lambda: features, grades, scaled=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(weights, tokens, features, scaled=True)
        for whole in batches:
            for batch in slices(whole, text):
                s = np.array([score(t) for t in batch.column(text).to_pylist()])
                above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -500, 500)))
                tail = above[:, least - 1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= cut_off)],
                                                 [*batch.schema.names, "expected_grade", "tail_probability", "kept"])

    added = [StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("kept", BooleanType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))
