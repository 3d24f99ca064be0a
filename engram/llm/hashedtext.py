"""Linear models over hashed text: features of distinct tokens, cumulative-link training, scoring by token.

Training runs in one task over a bounded, documented number of rows; scoring runs wherever the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed weights of a model.
WIDTH = 1 << 18
#: Tokens whose features or weight a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
#: How many standard deviations the mean grade of a feature's rows must lie off the mean of all.
CLEAR = 4.0

Tokens = Callable[[str], tuple[set[str], set[str]]]
Features = Callable[[str], list[str]]


def spot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (WIDTH - 1)


class Memory(dict):
    """Computes what it does not hold, and forgets all beyond a bound."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


def train(t: pa.Table, grades: int, emphasis: float, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from rows (label, ids, weight, head): the first ``head`` ids count ``weight``, the others 1.

    Rows are read where they lie; only what their clear features need is copied.
    """
    column, rows, parts = t.column("ids"), [], []
    for i in pc.sort_indices(t, [("ids", "ascending"), ("label", "descending")]).to_pylist():  # the sums do not depend on how rows came
        x = np.frombuffer(column[i].as_buffer(), np.int32)
        if not parts or not np.array_equal(x, parts[-1]):  # copies teach once
            rows.append(i)
            parts.append(x)
    y, weight, head = (t.column(c).to_numpy()[rows] for c in ("label", "weight", "head"))
    y = y.astype(np.int64)
    # only features whose rows have grades clearly off the mean take part
    n, total = np.zeros(WIDTH, np.int64), np.zeros(WIDTH)
    for x, grade in zip(parts, y):
        once = np.unique(x)
        n[once] += 1
        total[once] += grade
    clear = np.abs(total - n * y.mean()) / np.sqrt((n + 5) * max(y.var(), 1e-9)) >= CLEAR
    keep = [clear[x] for x in parts]
    values = np.concatenate([np.repeat(np.array([w, 1.0], np.float32), [k[:h].sum(), k[h:].sum()]) for k, w, h in zip(keep, weight, head)])
    doc = np.repeat(np.arange(len(y)), [k.sum() for k in keep])
    used, ids = np.unique(np.concatenate([x[k] for x, k in zip(parts, keep)]), return_inverse=True)
    above = y[:, None] > np.arange(grades - 1)[None, :]
    shares = (above.sum(axis=0) + 1) / (len(y) + 2)
    theta = np.log((1 - shares) / shares)
    w, stress = np.zeros(len(used)), np.where(y > 0, emphasis, 1.0)
    if len(np.unique(y)) > 1:
        m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            score = np.bincount(doc, values * w[ids], len(y))
            miss = (1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30))) - above) * stress[:, None]
            g = np.bincount(ids, values * miss.sum(axis=1)[doc], len(used)) / len(y) + l2 * w
            gt = -miss.mean(axis=0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt * gt
            fix, fix2 = 1 - 0.9**i, 1 - 0.999**i
            w -= 0.1 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
            theta = np.maximum.accumulate(theta - 0.1 * (mt / fix) / (np.sqrt(vt / fix2) + 1e-8))
    out = np.zeros(WIDTH, np.float32)
    out[used] = w
    return out, theta


def fit(rows: DataFrame, label: str, text: str, tokens: Callable[[], Tokens], features: Callable[[], Features], grades: int,
        scaled: bool, emphasis: float = 1.0, rounds: int = 400, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade > j) = sigmoid(score - threshold j), from a bounded number of rows.

    A token counts once a document, times 1 / sqrt(tokens) if ``scaled``; the second set that ``tokens`` gives is never
    scaled. Rows above the lowest grade weigh ``emphasis``. Without rows, or with one grade only, the weights are 0 and the thresholds follow the smoothed shares.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, of = tokens(), features()
        known = Memory(lambda t: np.array([spot(f) for f in of(t)], np.int32).tobytes())
        for batch in batches:
            ids, weights, heads = [], [], []
            for t in batch.column("text").to_pylist():
                words, whole = split(t or "")
                one, two = (b"".join(map(known.__getitem__, sorted(x))) for x in (words, whole))
                ids.append(one + two)
                weights.append(1 / np.sqrt(max(1, len(words))) if scaled else 1.0)
                heads.append(len(one) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.binary()), pa.array(weights, pa.float32()), pa.array(heads, pa.int32())],
                                             ["label", "ids", "weight", "head"])

    def taught(t: pa.Table) -> pa.Table:
        weights, thresholds = train(t, grades, emphasis, rounds, l2)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "thresholds": pa.array([thresholds.tolist()], pa.list_(pa.float64()))})

    shown = rows.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    got = (shown.mapInArrow(extract, "label int, ids binary, weight float, head int").withColumn("one", F.lit(1))
           .groupBy("one").applyInArrow(taught, "weights binary, thresholds array<double>").collect())
    if not got:
        return np.zeros(WIDTH, np.float32), np.zeros(grades - 1)
    return np.frombuffer(got[0].weights, np.float32), np.array(got[0].thresholds)


def scorer(weights: np.ndarray, tokens: Tokens, features: Features, scaled: bool) -> Callable[[str], float]:
    known = Memory(lambda t: float(sum(weights[spot(f)] for f in features(t))))

    def score(text: str) -> float:
        words, whole = tokens(text or "")
        # sums in a fixed order, so that a score is the same wherever it is computed
        return sum(sorted(map(known.__getitem__, words))) * (1 / np.sqrt(max(1, len(words))) if scaled else 1.0) + sum(sorted(map(known.__getitem__, whole)))
    return score


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder; rows without an id are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(labels: DataFrame, key: str, label: Column, bound: int) -> DataFrame:
    """(key, label): at most ``bound`` labelled rows outside the held-out fold, the same ones each time."""
    rows = labels.select(F.col(key).alias("key"), label.alias("label")).where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
    return rows.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(bound)
