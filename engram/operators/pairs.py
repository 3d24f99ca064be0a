"""Similar pairs without comparing everything with everything (J-03 … J-06, J-08)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions import text as T
from engram.session import cut

POSTINGS_PER_TASK = 4000
#: Rows times words of one key up to which one task compares them.
CELLS_IN_TASK = 1 << 24
VECTORS_PER_BLOCK = 1024
#: Pivots that part a large group of vectors.
PIVOTS = 256


def distinct_sets(sets: DataFrame, keys: Sequence[str], id_col: str, words: str) -> tuple[DataFrame, DataFrame]:
    """(rows, distinct): rows (keys, id, words) with words in order, and each different set (keys, id, words, n, copies) under the smallest id that has it."""
    keys = list(keys)
    # filtered only once written: a filter on words would find them in the texts a second time
    rows = cut(sets.select(*keys, F.col(id_col).alias("id"), F.sort_array(words).alias("words"))).filter(F.size("words") > 0)
    distinct = (rows.groupBy(*keys, F.xxhash64("words").alias("_h"), "words").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
                .select(*keys, "id", "words", F.size("words").alias("n"), "copies"))
    return rows, cut(distinct)


def distinct_pairs(base: DataFrame, keys: Sequence[str], threshold: float, measure: str = "jaccard",
                   cells_in_task: int = CELLS_IN_TASK) -> DataFrame:
    """Pairs (id_a < id_b) of different sets of ``base`` (see ``distinct_sets``) that reach ``threshold``, with counts and copies.

    Exact. What ``keys`` holds few words is compared in one task, the rest by joins; both find the same pairs.
    """
    if measure not in ("jaccard", "overlap"):
        raise ValueError(f"unknown measure {measure}")
    keys = list(keys)
    large = cut(base.groupBy(*keys).agg((F.count("*") * F.sum("n")).alias("_cells")).filter(F.col("_cells") > cells_in_task).select(*keys))
    if large.isEmpty():
        return _pairs_in_tasks(base, keys, threshold, measure)
    return _pairs_in_tasks(base.join(large, keys, "left_anti"), keys, threshold, measure).unionByName(
        _pairs_by_join(base.join(large, keys, "left_semi"), keys, threshold, measure))


def _pairs_in_tasks(base: DataFrame, keys: list[str], threshold: float, measure: str) -> DataFrame:
    """The pairs of each key from one product of its rows-by-words matrix with itself."""
    kind = base.schema["id"].dataType
    schema = StructType([*[base.schema[k] for k in keys], StructField("id_a", kind), StructField("id_b", kind),
                         *StructType.fromDDL("n_a int, n_b int, shared int, score double, copies_a long, copies_b long").fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        words = table.column("words").combine_chunks()
        coded, n = words.flatten().dictionary_encode(), words.value_lengths().to_numpy(zero_copy_only=False)
        held = np.zeros((len(n), len(coded.dictionary)), np.float32)
        held[np.repeat(np.arange(len(n)), n), coded.indices.to_numpy()] = 1
        shared = np.triu(held @ held.T, 1).astype(np.int64)
        i, j = np.nonzero(shared)
        met = shared[i, j]
        score = met / (n[i] + n[j] - met if measure == "jaccard" else np.minimum(n[i], n[j]))
        i, j, met, score = (x[score >= threshold] for x in (i, j, met, score))
        at = lambda name, rows: table.column(name).take(pa.array(rows))
        return pa.table([*[at(k, i) for k in keys], at("id", i), at("id", j), pa.array(n[i], pa.int32()), pa.array(n[j], pa.int32()), pa.array(met, pa.int32()),
                         pa.array(score), at("copies", i), at("copies", j)], [f.name for f in schema.fields])

    return base.select(*keys, "id", "words", "copies").groupBy(*keys).applyInArrow(run, schema)


def _pairs_by_join(base: DataFrame, keys: list[str], threshold: float, measure: str) -> DataFrame:
    """The pairs of keys of any size. Words are ordered rare first; a pair that qualifies must share a word within the leading part of the smaller set (of both
    sets for Jaccard), and at the first word they share enough words must follow in both. A long posting list is split into blocks that
    meet block by block, so no task holds a whole list on either side. Candidates are then measured on the whole sets.
    """
    postings = base.select(*keys, "id", "n", F.explode("words").alias("word"))
    spread = postings.groupBy(*keys, "word").agg(F.count("*").alias("df"))
    position = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("df", "word"))
    blocks = F.ceil(F.col("df") / POSTINGS_PER_TASK).cast("int")
    need = F.ceil(F.col("n") * threshold - 1e-9)
    ranked = (postings.join(spread, [*keys, "word"]).withColumn("pos", position).filter("df > 1")
              .withColumns({"lead": F.col("n") - need + 1, "rest": F.col("n") - F.col("pos") + 1, "blocks": blocks, "block": F.pmod(F.hash("id"), blocks)}))
    ranked = ranked.filter("pos <= lead") if measure == "jaccard" else ranked
    celled = ranked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda name, cell: celled.select(*keys, "word", F.col("id").alias(name), F.col("n").alias(f"{name}n"), F.col("rest").alias(f"{name}rest"),
                                            F.col("pos").alias(f"{name}pos"), F.col("lead").alias(f"{name}lead"), cell.alias("cell"))
    # a cell is (block of the left row, block of the right row)
    left = side("l", F.struct(F.col("block").alias("i"), F.col("other").alias("j"))).filter("lpos <= llead")
    right = side("r", F.struct(F.col("other").alias("i"), F.col("block").alias("j")))
    # the left row is the smaller set, ties go to the smaller id
    ordered = (F.col("ln") < F.col("rn")) | ((F.col("ln") == F.col("rn")) & (F.col("l") < F.col("r")))
    follow = F.least("lrest", "rrest")
    if measure == "jaccard":
        ordered = ordered & (F.col("ln") >= F.col("rn") * threshold - 1e-9) & (follow >= F.ceil(threshold / (1 + threshold) * (F.col("ln") + F.col("rn")) - 1e-9))
    else:
        ordered = ordered & (follow >= F.ceil(F.col("ln") * threshold - 1e-9))
    candidates = left.join(right, [*keys, "word", "cell"]).filter(ordered).select(*keys, "l", "r").distinct()
    a = base.select(*keys, F.col("id").alias("l"), F.col("words").alias("lw"), F.col("copies").alias("lc"))
    b = base.select(*keys, F.col("id").alias("r"), F.col("words").alias("rw"), F.col("copies").alias("rc"))
    shared = F.size(F.array_intersect("lw", "rw"))
    n_l, n_r = F.size("lw"), F.size("rw")
    score = shared / (n_l + n_r - shared) if measure == "jaccard" else shared / F.least(n_l, n_r)
    swap = F.col("l") > F.col("r")
    pick = lambda x, y: F.when(swap, y).otherwise(x)
    return (candidates.join(a, [*keys, "l"]).join(b, [*keys, "r"])
            .select(*keys, pick(F.col("l"), F.col("r")).alias("id_a"), pick(F.col("r"), F.col("l")).alias("id_b"), pick(n_l, n_r).alias("n_a"), pick(n_r, n_l).alias("n_b"),
                    shared.alias("shared"), score.alias("score"), pick(F.col("lc"), F.col("rc")).alias("copies_a"), pick(F.col("rc"), F.col("lc")).alias("copies_b"))
            .filter(F.col("score") >= threshold))


def word_pairs(sets: DataFrame, keys: Sequence[str], id_col: str, words: str, threshold: float,
               measure: str = "jaccard", cells_in_task: int = CELLS_IN_TASK) -> DataFrame:
    """All pairs (id_a < id_b) within ``keys`` whose word sets reach ``threshold``, with counts and score (J-05).

    Equal sets are compared once and written out at the end. What only counts pairs should use ``distinct_pairs``, whose size does not grow with copies.
    """
    keys = list(keys)
    rows, base = distinct_sets(sets, keys, id_col, words)
    found = distinct_pairs(base, keys, threshold, measure, cells_in_task).drop("copies_a", "copies_b")
    if base.filter("copies > 1").isEmpty():
        return found
    member = cut(rows.join(base.select(*keys, "words", "n", F.col("id").alias("first"), "copies"), [*keys, "words"]).select(*keys, "first", "id", "n", "copies"))
    a = member.select(*keys, F.col("first").alias("id_a"), F.col("id").alias("_a"))
    b = member.select(*keys, F.col("first").alias("id_b"), F.col("id").alias("_b"))
    swap = F.col("_a") > F.col("_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    across = found.join(a, [*keys, "id_a"]).join(b, [*keys, "id_b"]).select(
        *keys, pick("_a", "_b").alias("id_a"), pick("_b", "_a").alias("id_b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "shared", "score")
    same = member.filter("copies > 1")
    within = (same.join(same.select(*keys, "first", F.col("id").alias("_b")), [*keys, "first"]).filter(F.col("id") < F.col("_b"))
              .select(*keys, F.col("id").alias("id_a"), F.col("_b").alias("id_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("shared"), F.lit(1.0).alias("score")))
    return across.unionByName(within)


def contradicts() -> Column:
    """Same claim shape, different object: enough shared words, and each side has some of its own."""
    return (F.col("shared") >= 2) & (F.col("n_a") > F.col("shared")) & (F.col("n_b") > F.col("shared"))


def _stances(memories: DataFrame, buckets: Mapping[str, Sequence[str]], types: Sequence[str] | None) -> DataFrame:
    from engram.operators.eligibility import stance_memories
    return stance_memories(memories, buckets, types).withColumn("_w", T.word_set(F.col("content"), V.STOPWORDS))


def contradictory_pairs(memories: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS,
                        threshold: float = V.CONTRADICT_AT, types: Sequence[str] | None = V.STANCE_TYPES,
                        keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Pairs of stance-bearing rows that conflict (J-06)."""
    return word_pairs(_stances(memories, buckets, types), keys, "memory_id", "_w", threshold, "overlap").filter(contradicts())


def contradictions(memories: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS, threshold: float = V.CONTRADICT_AT,
                   types: Sequence[str] | None = V.STANCE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(counts, rows) of the conflicts of each user without writing pairs of rows: (user_id, conflict_count) and the (memory_id) that have any.

    Rows with equal words contradict the same rows and never each other, so different word sets meet once and count by their copies.
    """
    rows, base = distinct_sets(_stances(memories, buckets, types), ["user_id"], "memory_id", "_w")
    pairs = cut(distinct_pairs(base, ["user_id"], threshold, "overlap").filter(contradicts()).select("user_id", "id_a", "id_b", "copies_a", "copies_b"))
    counts = pairs.groupBy("user_id").agg(F.sum(F.col("copies_a") * F.col("copies_b")).alias("conflict_count"))
    marked = pairs.select("user_id", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    sets = base.join(marked, ["user_id", "id"], "left_semi").select("user_id", "words")
    return counts, rows.join(sets, ["user_id", "words"], "left_semi").select(F.col("id").alias("memory_id"))


def _cells(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """(keys, id, v, pivot, angle) of groups of several blocks: the nearest of the group's pivots to each row, and how far it is off.

    Pivots are rows with the least hashes, ``PIVOTS`` a group at most. They meet the rows of a group in parts of bounded size.
    """
    types = dict(rows.dtypes)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id"))
    pivots = cut(rows.join(sizes.select(*keys, "blocks"), keys).withColumn("pivot", place).filter(F.col("pivot") <= F.least(3 * F.col("blocks"), F.lit(PIVOTS)))
              .select(*keys, "pivot", F.col("v").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")))
    parted = rows.join(sizes.select(*keys, "blocks"), keys).select(*keys, "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int").alias("part"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", id {types['id']}, v {types['v']}, pivot int, angle double"

    def near(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = mine.drop(columns="part").assign(pivot=0, angle=np.pi)
        for dim, same in mine.groupby(mine["v"].map(len)):
            with_length = theirs[theirs["p"].map(len) == dim]
            if len(with_length):
                cos = _unit(same["v"]) @ _unit(with_length["p"]).T
                best = cos.argmax(axis=1)
                out.loc[same.index, "pivot"] = with_length["pivot"].to_numpy()[best]
                out.loc[same.index, "angle"] = np.arccos(np.clip(cos[np.arange(len(best)), best], -1, 1))
        return out

    return parted.groupBy(*keys, "part").cogroup(pivots.groupBy(*keys, "part")).applyInPandas(near, schema)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    size = np.linalg.norm(m, axis=1)
    return np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)


def vector_blocks(rows: DataFrame, keys: Sequence[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, meetings): rows (keys, id, v, block) and the pairs (keys, lo, hi) of blocks that can hold a pair of rows at ``threshold``.

    A group of several blocks is cut along its pivots, so that a block holds rows on one side of the sphere. Two blocks whose nearest rows cannot be
    within the angle of the threshold, by the triangle inequality over the angles to a pivot, do not meet.
    """
    keys = list(keys)
    sizes = cut(rows.groupBy(*keys).agg(F.ceil(F.count("*") / VECTORS_PER_BLOCK).cast("int").alias("blocks")))
    one = rows.join(sizes.filter("blocks = 1"), keys, "left_semi").withColumn("block", F.lit("0"))
    alone = sizes.filter("blocks = 1").select(*keys, F.lit("0").alias("lo"), F.lit("0").alias("hi"))
    several = sizes.filter("blocks > 1")
    if several.isEmpty():
        return one, alone
    celled = cut(_cells(rows.join(several, keys, "left_semi"), keys, several))
    many = celled.groupBy(*keys, "pivot").agg(F.ceil(F.count("*") / VECTORS_PER_BLOCK).cast("int").alias("_n"))
    placed = cut(celled.join(many, [*keys, "pivot"]).withColumn("block", F.concat_ws(":", "pivot", F.pmod(F.hash("id"), "_n"))))
    shells = placed.groupBy(*keys, "block", "pivot").agg(F.max("angle").alias("far"))
    centres = placed.join(placed.groupBy(*keys, "pivot").agg(F.min_by("id", F.struct("angle", "id")).alias("id"), F.min("angle").alias("off")), [*keys, "pivot", "id"]).select(*keys, "pivot", F.col("v").alias("c"), "off")
    ends = shells.join(centres, [*keys, "pivot"]).select(*keys, "block", "c", (F.col("far") + F.col("off")).alias("reach"))
    a = ends.select(*keys, F.col("block").alias("lo"), F.col("c").alias("ca"), F.col("reach").alias("ra"))
    b = ends.select(*keys, F.col("block").alias("hi"), F.col("c").alias("cb"), F.col("reach").alias("rb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, w: u.cast("double") * w.cast("double")), F.lit(0.0), lambda s, u: s + u)
    cos = dot("ca", "cb") / F.sqrt(dot("ca", "ca") * dot("cb", "cb"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    # a centre of length zero or of another length rules nothing out; a little slack for rounding
    meet = (a.join(b, keys).filter(F.col("lo") <= F.col("hi"))
            .filter((F.col("lo") == F.col("hi")) | F.coalesce(F.isnan(apart), F.lit(True)) | (apart - F.col("ra") - F.col("rb") <= float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6)))
    return one.unionByName(placed.select(*one.columns)), alone.unionByName(meet.select(*keys, "lo", "hi"))


def vector_pairs(vectors: DataFrame, keys: Sequence[str], id_col: str, threshold: float, strict: bool = False,
                 embedding: str = "embedding") -> DataFrame:
    """All pairs (id_a < id_b) within ``keys`` with cosine at or above ``threshold`` (J-03, J-04).

    A group is cut into blocks of bounded size; each task multiplies one pair of blocks and
    returns only the pairs that qualify, so no task ever holds a whole large group. Pairs of blocks too far apart are not sent.
    """
    keys = list(keys)
    rows = vectors.filter(F.size(embedding) > 0).select(*keys, F.col(id_col).alias("id"), F.col(embedding).alias("v"))
    placed, meetings = vector_blocks(rows, keys, threshold)
    ends = meetings.select(*keys, "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    blocked = placed.join(ends, [*keys, "block"])
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", id_a {types['id']}, id_b {types['id']}, score double"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, same in pdf.groupby(pdf["v"].map(len)):  # only vectors of one length compare
            m = _unit(same["v"])
            lo, hi = same["lo"].iloc[0], same["hi"].iloc[0]
            block, ids = same["block"].to_numpy(), same["id"].to_numpy()
            left = np.flatnonzero(block == lo)
            right = left if lo == hi else np.flatnonzero(block == hi)
            scores = m[left] @ m[right].T
            i, j = np.nonzero(scores > threshold if strict else scores >= threshold)
            a, b = ids[left[i]], ids[right[j]]
            keep = (a < b) if lo == hi else (a != b)
            first = np.minimum(a, b) if a.dtype != object else np.where(a < b, a, b)
            last = np.maximum(a, b) if a.dtype != object else np.where(a < b, b, a)
            part = pd.DataFrame({"id_a": first[keep], "id_b": last[keep], "score": scores[i, j][keep]})
            found.append(part)
        out = pd.concat(found) if found else pd.DataFrame({"id_a": [], "id_b": [], "score": []})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "id_a", "id_b", "score"]]

    return blocked.groupBy(*keys, "lo", "hi").applyInPandas(compare, schema)


def shared_group_matches(new_rows: DataFrame, stored: DataFrame, groups: Mapping[str, Sequence[str]] = V.CONCEPT_GROUPS,
                         per_group: float = 0.05) -> DataFrame:
    """Stored memories that touch a keyword group the new text touches, and their strength gain (J-08).

    New texts collapse to their distinct (user, group) set first, so a busy user sends a
    handful of rows to the join.
    """
    wanted = (new_rows.select("user_id", F.explode(T.concept_groups(F.col("text"), groups)).alias("group")).distinct())
    have = stored.select("user_id", "memory_id", F.explode(T.concept_groups(F.col("content"), groups)).alias("group"))
    return (have.join(wanted, ["user_id", "group"]).groupBy("user_id", "memory_id")
            .agg(F.count_distinct("group").alias("n_groups"))
            .withColumn("strength_gain", F.col("n_groups") * per_group))
