"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import bitsliced, bpe, catalog, common, crosspolytope, linededup, minhash, mixing, quality, ring, suffixes, toxicity
from engram.llm.common import components
from engram.llm.shingles import shingle_sets

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


def documents() -> list[tuple]:
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "über", "naïve", "x", "theta", "omega", "kappa", "1d10t", "the"]
    texts: list[str | None] = [None, "", "one", "a b", " \n\t ", "\n\n", "é" * 30]
    line = "A line that many documents hold, word for word."
    for i in range(30):
        body = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 80)))
        texts.append(body + ("\n" + (line if i % 2 else "  " + line.upper() + " \t") if i % 3 == 0 else "") + "\n" + body[:20])
    base = [rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(120)]
    for i in range(12):
        copy = list(base)
        for _ in range(i % 4):
            copy[rnd.randrange(120)] = "changed" + str(i)
        texts.append(" ".join(copy))
    texts += [texts[-1]] * 3 + ["word " * 400, "word " * 400, "z" * 700, " ".join(base * 30)]
    rows = [(i if i % 11 else None if i == 11 else i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20]]  # rows that repeat


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).withColumns({c: F.lit(-1) for c in ("node", "batch", "ids", "score", "n_lines", "slot", "kept", "h", "part")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def ordered(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


# ---- vectors ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 0.3, 24)], 0) for i in range(300)]
    rows += [(300 + i, rows[10 * i][1], 1) for i in range(5)]  # ties
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 24, 0), (403, [float("nan")] * 24, 0), (404, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (405, [float("inf")] * 24, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(rows, measure, k=5):
    out = {}
    for r in rows:
        if r[0] % 10 == 0:
            best = sorted((-measure(r[1], c[1]), c[0]) for c in rows if c[0] != r[0])[:k]
            out[r[0]] = [(v, -s) for s, v in best]
    return out


def test_bit_sliced_top_k_is_exact(vectors):
    rows = [(r.vec_id, [int(np.floor(256 * x)) for x in r.embedding]) for r in vectors.collect()
            if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = brute(rows, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    for dropped in (0, 3):
        got = collections.defaultdict(list)
        for r in bitsliced.top_k(vectors, "vec_id", "embedding", bitsliced.every(10), 5, dropped=dropped, block=64, chunk=16).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want


def test_cross_polytope_recall_and_scores(vectors):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()
            if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want, by_id = brute(rows, cosine), dict(rows)
    got = crosspolytope.neighbours(vectors, "vec_id", "embedding", crosspolytope.every(10), 5, block=64).collect()
    assert all(abs(r.score - cosine(by_id[r.query_id], by_id[r.vec_id])) < 1e-12 for r in got)
    found = {(r.query_id, r.vec_id) for r in got}
    truth = {(q, v) for q, best in want.items() for v, _ in best}
    assert len(found & truth) / len(truth) >= 0.9
    whole = crosspolytope.neighbours(vectors, "vec_id", "embedding", crosspolytope.every(10), 5, tables=1, probes=64).collect()
    assert {(r.query_id, r.vec_id) for r in whole} == truth


def test_vector_queries_on_nothing(spark, vectors):
    none = vectors.where("vec_id < 0")
    assert bitsliced.top_k(none, "vec_id", "embedding", bitsliced.every(10), 5).count() == 0
    assert crosspolytope.neighbours(none, "vec_id", "embedding", crosspolytope.every(10), 5).count() == 0


# ---- sharding --------------------------------------------------------------------------------
@pytest.mark.parametrize("shards", [4, 40, 70])
def test_ring_bounds_loads_exactly(docs, shards):
    rows = ring.assign(docs, shards).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib
    want = sorted((ordered(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in documents())
    assert sorted((ordered(r.doc_id), r.size, r.text_crc32) for r in rows) == want


def test_ring_walk_matches_a_step_by_step_walk(spark, docs):
    """Replays the walk on single nodes: own arcs first, then what overflows, clockwise."""
    shards, slots = 5, 256
    rows = ring.assign(docs, shards, slots=slots).collect()
    hashes = [(r.place, r.doc_id) for r in docs.select(F.pmod(ring.text_hash(F.col("text")), F.lit(slots)).alias("place"), "doc_id").collect()]
    nodes = [(r.node, r.shard, r.at) for r in ring.nodes(spark, shards, slots=slots).orderBy("node").collect()]
    arcs = collections.Counter()
    for place, _ in hashes:
        arcs[next((n for n, _, at in nodes if at >= place), nodes[0][0])] += 1
    n = len(hashes)
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    over, kept = {}, collections.Counter()
    for node, s, _ in nodes:
        stay = min(room[s], arcs[node])
        room[s] -= stay
        kept[s, s] += stay
        over[node] = arcs[node] - stay
    home, waiting = {node: s for node, s, _ in nodes}, collections.deque()
    for lap in range(2):
        for node, s, _ in nodes:
            if lap == 0:
                waiting.extend([node] * over[node])
            while waiting and room[s]:
                kept[home[waiting.popleft()], s] += 1
                room[s] -= 1
    assert collections.Counter((r.arc_shard, r.shard) for r in rows) == +kept


def test_ring_on_nothing(nothing):
    assert ring.assign(nothing, 40).count() == 0


# ---- substrings ------------------------------------------------------------------------------
def test_repeated_substrings(docs):
    for length, q, narrower in ((100, 24, 4), (20, 6, 2)):
        rows = sorted({(ordered(d[0]), d[1] or "") for d in documents()})
        seen, want = set(), collections.Counter()
        for _, text in rows:
            b = text.encode()
            covered = bytearray(len(b))
            for i in range(len(b) - length + 1):
                w = b[i:i + length]
                if w in seen:
                    covered[i:i + length] = b"\1" * length
                seen.add(w)
            kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
            want[len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(covered))), kept] += 1
        got = suffixes.without_repeats(docs, length=length, q=q, narrower=narrower, batch_bytes=4_000).dropDuplicates(["doc_id", "n_bytes", "kept"]).collect()
        assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_repeated_substrings_of_rows_that_share_an_id(spark):
    """Texts of one id, or of none, are documents of their own, in the order of their hashes."""
    rnd = random.Random(6)
    unique = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    same = unique(200)
    rows = [(None, unique(50) + same * 2 + unique(90)), (None, unique(700)), (None, same + unique(150)), (None, same + unique(80)), (7, same + unique(40)), (7, unique(30) + same),
            (8, None), (8, ""), (8, unique(120)), (9, unique(300))]
    rows += [rows[0], rows[3], rows[3], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = set(), collections.Counter()
    ordered_rows = docs.distinct().select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()
    for doc_id, text, _ in ordered_rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                covered[i:i + 100] = b"\1" * 100
            seen.add(b[i:i + 100])
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        want[doc_id, len(b), len(b) - len(kept), kept] += rows.count((doc_id, text))
    got = suffixes.without_repeats(docs, batch_bytes=500).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want


def test_repeated_substrings_on_nothing(nothing):
    assert suffixes.without_repeats(nothing).count() == 0


# ---- near copies -----------------------------------------------------------------------------
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        ids[g].append(i)
    return [(i, len(s), min((x for x in ids[g] if x is not None), default=None)) for g, (i, _), s in zip(group, rows, sets, strict=True)]


@pytest.mark.parametrize("block", [64, 3])
def test_near_copies(docs, block):
    want = collections.Counter(near_groups([(d[0], d[1]) for d in documents()]))
    got = minhash.groups(docs, block=block).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_chain_of_near_copies_is_one_group(spark):
    rnd = random.Random(9)
    text, rows = [f"w{i}" for i in range(300)], []
    for i in range(60):
        text = list(text)
        text[rnd.randrange(300)] = f"v{i}"
        text[rnd.randrange(300)] = f"u{i}"
        rows.append((i, " ".join(text)))
    rnd.shuffle(rows)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=32, block=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(near_groups(rows))


def test_near_copies_on_nothing(nothing):
    assert minhash.groups(nothing).count() == 0


def test_near_copies_leave_only_the_rows_they_return(spark, docs, monkeypatch):
    """Shuffle files and tables of finished steps go while the query runs."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    common.free(spark)
    time.sleep(1)
    kept = {str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())}
    written, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: written.append(cut(df)) or written[-1])
    base, _ = minhash._grouped(docs, "doc_id", "text", 5, 75, 64, 64)
    left = [t for t in written if {"sketch", "full", "v", "own"} & set(t.columns) and Path(t.inputFiles()[0].removeprefix("file:")).exists()]
    assert [t.columns for t in left if t.inputFiles() != base.inputFiles()] == []
    for _ in range(50):
        files = {str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())} - kept
        if not files:
            break
        time.sleep(0.2)
    assert not files


@pytest.mark.parametrize("block", [512, 8])
def test_a_dense_group_of_texts_around_the_threshold_makes_no_table_of_its_pairs(spark, monkeypatch, block):
    rnd, rows = random.Random(5), []
    for i in range(300):
        text = [f"w{j}" for j in range(150)]
        for _ in range(3):
            text[rnd.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(text)))
    written, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: written.append((df.columns, (out := cut(df)).count())) or out)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = near_groups(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(want)
    assert len({g for *_, g in want}) > 20
    assert max(n for columns, n in written if columns == ["a", "b"]) < 10 * len(rows)


def test_only_texts_that_may_be_needed_are_shuffled(docs, monkeypatch):
    plans, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    minhash._grouped(docs, "doc_id", "text", 5, 75, 64, 64)
    plan = next(plan for columns, plan in plans if columns == ["node", "n", "full"])
    assert re.search(r"Join \w+, \(text_key#.*getbit", plan, re.DOTALL)


def test_rows_among_ids(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    ids = rows.where("id % 100 = 0").select("h")
    got = [r.id for r in common.among(rows, "h", ids).collect()]
    assert len(got) == len(set(got)) <= 210 and set(range(0, 20_000, 100)) <= set(got)
    assert common.among(rows, "h", ids.where("h is null")).count() == 0


def test_overlaps_of_sets():
    rnd = random.Random(3)
    one, two = ([np.array(sorted(rnd.sample(range(-20, 20), rnd.randrange(12))), np.int64) for _ in range(n)] for n in (7, 5))
    for x, y in ((one, two), (one, one)):
        assert minhash._overlaps(x, y, 3).tolist() == [[len({*a} & {*b}) for b in y] for a in x]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (600, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500}


def test_shingles_of_one_very_long_word():
    import pyarrow as pa
    sets = shingle_sets(pa.array(["a" * 5_000_000 + " b c d e", "A" * 5_000_000 + " b c d E", None]), 5)
    assert sets[0].tolist() == sets[1].tolist() and len(sets[2]) == 0


# ---- lines -----------------------------------------------------------------------------------
def test_lines(docs):
    rows = [(ordered(d[0]), d[1] or "") for d in documents()]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    holders = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            holders[k].append(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = collections.Counter()
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = linededup.dedup(docs, batch_bytes=3_000, shard_keys=8)
    assert set(got.columns) == set(docs.columns) | {"n_dropped"}
    assert collections.Counter((ordered(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want


def test_lines_on_nothing(nothing):
    assert linededup.dedup(nothing).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5_000).astype(np.uint64)
    levels = linededup.PerfectHash.build(keys)
    assert sorted(linededup.PerfectHash.find(levels, keys)) == list(range(5_000))
    assert linededup.PerfectHash.build(keys[:0]) == []


# ---- tokens ----------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [bpe.CHUNK, 64])
def test_tokens_match_the_library_and_come_back(spark, docs, chunk):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    odd = ["".join(rnd.choice(["ab", "  ", "\n\n", " x", "é", "9", " don't", "!!", "'s", "　", "<|endoftext|>"]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text", "ids").unionByName(more, allowMissingColumns=True), PATH, PATTERN, chunk=chunk, overlap=16), PATH, PATTERN).collect()
    assert len(out) == docs.count() + 60
    for r in out:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_tokens_on_nothing(nothing):
    assert bpe.decode(bpe.encode(nothing, PATH, PATTERN), PATH, PATTERN).count() == 0


# ---- scores ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(5)
    clean = ["river", "stone", "garden", "window", "letter", "music", "morning", "paper", "table", "road", "1st", "2nd"]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["grumblefig", "snotwaffle"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if i % 10 == 3 else 1, int(toxic)))
        if i % 10 == 3:
            rows[-1] = (i, " ".join(rnd.choice(clean).upper() + "!!" for _ in range(rnd.randint(5, 40))))
    labels += [(5, None, None), (None, 1, 1), (10**6, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_sees_through_disguise(spark, rated):
    docs, labels = rated
    extra = [(9000, "the g r u m b l e f i g sat"), (9002, "snotw@ffle!!"), (9003, "you snooootwaffle"), (9004, "river stone 1st"), (9005, None), (9006, ""), (9007, "s.n.o.t.w.a.f.f.l.e")]
    got = {r.doc_id: r.score for r in toxicity.with_scores(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")), labels).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id < 1000 and toxic is not null").collect()}
    right = sum((got[i] >= 0.5) == bool(t and i % 10 != 3) for i, t in toxic.items())
    assert right / len(toxic) > 0.97
    assert {i for i in got if i >= 9000 and got[i] >= 0.5} == {9000, 9002, 9003, 9007}


def test_toxicity_without_labels_or_rows(docs, nothing, rated):
    none = rated[1].limit(0)
    assert {r.score for r in toxicity.with_scores(docs, none).collect()} == {0.5}
    assert toxicity.with_scores(nothing, rated[1]).count() == 0


def test_quality_orders_grades(rated):
    docs, labels = rated
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    got = quality.with_grades(docs, labels, grade, 3).collect()
    mean = {g: np.mean([r.expected_grade for r in got if (0 if r.doc_id % 10 == 3 else 1 if r.doc_id % 4 == 0 else 2) == g]) for g in range(3)}
    assert mean[0] < mean[1] < mean[2]
    assert sum(r.kept == (r.doc_id % 10 != 3) for r in got) / len(got) > 0.97


def test_quality_without_labels_or_rows(docs, nothing, rated):
    grade = F.col("quality")
    assert quality.with_grades(docs, rated[1].limit(0), grade, 3).count() == docs.count()
    assert quality.with_grades(nothing, rated[1], grade, 3).count() == 0


# ---- mixing ----------------------------------------------------------------------------------
def test_rows_are_dealt_out_once_to_be_numbered(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, kind int")
    numbered = common.ranked(rows, "kind", F.pmod("id", F.lit(4)), ["id"])
    assert sorted((r.kind, r.nth) for r in numbered.collect()) == sorted((i % 3, i // 3) for i in range(40))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = common.ranked(rows, "kind", F.pmod("id", F.lit(4)), ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 4  # the rows, their counts, the counts of a group and these for the rows


@pytest.mark.parametrize("weights", [[1], [3, 1], [226] + [41] * 19, [1] * 50, [997, 1, 1, 1]])
def test_schedule_stays_within_one_block(weights):
    plan, total = mixing.schedule(weights), sum(weights)
    owner = {s: i for i, row in enumerate(plan) for s in row}
    assert sorted(owner) == list(range(total))
    have = [0] * len(weights)
    for t in range(total):
        have[owner[t]] += 1
        assert all(abs(h - (t + 1) * w / total) < 1 for h, w in zip(have, weights, strict=True))


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.3, "s2": 0.1, None: 0.1}])
def test_mix_keeps_every_row_and_the_shares(docs, weights):
    got = mixing.mix(docs, weights=weights, block=2, slots=100).collect()
    rows = [(d[0], d[1], d[3]) for d in documents()]
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got if r.epoch == 0) == collections.Counter(rows)
    owner = {r.slot: r.source for r in got}
    assert sorted(owner) == list(range(len(owner)))
    counts = collections.Counter(r[2] for r in rows)
    shares = {s: (weights or {}).get(s) or n**0.7 for s, n in counts.items()}
    whole = sum(shares.values())
    units = {s: max(1, round(100 * a / whole)) for s, a in shares.items()}
    have = collections.Counter()
    for t in range(len(owner)):
        have[owner[t]] += 1
        assert all(abs(have[s] - (t + 1) * u / sum(units.values())) < 1 for s, u in units.items())


def shares_of(rows, weights, block):
    """Checks slots against the given weights, and gives the rows of each source."""
    owner = {r.slot: r.source for r in rows}
    assert sorted(owner) == list(range(len(owner)))
    assert set(collections.Counter(r.slot for r in rows).values()) <= {block}
    whole, have = sum(weights.values()), collections.Counter()
    for t in range(len(owner)):
        have[owner[t]] += 1
        assert all(abs(have[s] - (t + 1) * w / whole) < 1 + 1e-9 for s, w in weights.items())
    return collections.Counter(r.source for r in rows)


def test_mix_holds_the_given_weights(spark):
    rows = [(i, "big") for i in range(7_000)] + [(i, "rare") for i in range(8)] + [(i, "none") for i in range(9)] + [(i, "unnamed") for i in range(9)] + [(i, None) for i in range(65)]
    weights = {"big": 0.9896, "rare": 0.0004, "none": 0.0, None: 0.01, "absent": 0.5}
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, weights=weights, block=2).collect()
    sent = shares_of(got, {s: weights[s] for s in ("big", "rare", None)}, 2)
    assert set(sent) == {"big", "rare", None} and abs(sent["rare"] / len(got) - 0.0004) < 2 / len(got)
    assert collections.Counter((r.doc_id, r.source) for r in got if r.epoch == 0) == collections.Counter(r for r in rows if r[1] in ("big", "rare", None))
    assert max(collections.Counter((r.doc_id, r.source, r.epoch) for r in got).values()) == 1
    assert mixing.mix(docs, weights={"none": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"big": -1.0})


def test_mix_of_many_sources_and_of_part_blocks(spark):
    sizes = {f"z{i}": max(1, 3_000 // i) for i in range(1, 1_201)}
    got = mixing.mix(spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string"), block=4).collect()
    sent = shares_of(got, {s: n**0.7 for s, n in sizes.items()}, 4)
    assert abs(sent["z1"] / len(got) - 3_000**0.7 / sum(n**0.7 for n in sizes.values())) < 4 / len(got)
    part = mixing.mix(spark.createDataFrame([(i, s) for s, n in (("a", 65), ("b", 640)) for i in range(n)], "doc_id long, source string"), weights={"a": 0.5, "b": 0.5}).collect()
    assert len({*shares_of(part, {"a": 0.5, "b": 0.5}, 64).values()}) == 1


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("dim", [24, 64, 256, 1024])
def test_cross_polytope_recall_at_any_width(dim):
    """Unstructured vectors, the hardest case; every row is a query of one block."""
    rnd = np.random.default_rng(dim)
    rows = rnd.normal(size=(600, dim))
    keys = np.arange(600)
    query, found, score = crosspolytope.search(5, crosspolytope.TABLES, None, 7)(keys, rows, keys[:200], rows[:200])
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    cos = units[:200] @ units.T
    cos[np.arange(200), np.arange(200)] = -2
    best = np.argsort(-cos, axis=1)[:, :5]
    hits = sum(len(set(found[query == q]) & set(best[q])) for q in range(200))
    assert hits / 1_000 >= 0.9 and len(query) == 1_000


@pytest.mark.parametrize("n", [2, 4, 8, 20])
def test_cross_polytope_gives_all_candidates_of_small_tables(n):
    rows = np.random.default_rng(n).normal(size=(n, 64))
    query, found, _ = crosspolytope.search(5, crosspolytope.TABLES, None, 7)(np.arange(n), rows, np.arange(n), rows)
    assert all(len(set(found[query == q]) - {q}) == min(5, n - 1) for q in range(n))


def test_pipeline_without_labels_keeps_every_row(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "s", 13, 7) for i in range(20)], DOCS + ", id int")
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == 20
    assert corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS


def test_pipeline_on_an_empty_table(spark, tmp_path, nothing):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# ---- the pipeline ----------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(after.count())
        if name != "bpe":
            assert after.columns == docs.columns
        before = after
    assert sizes[0] <= docs.count() and sizes[1] == sizes[0] and sizes[2] <= sizes[1] and sizes[3] >= sizes[2] and sizes[4] == sizes[3]
    near = spark.read.parquet(str(tmp_path / "2")).collect()
    left = near_groups([(r.doc_id, r.text) for r in near])
    assert all(i == c for i, _, c in left)
    final = {r.doc_id: r for r in before.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(final[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items())


def test_pipeline_keeps_one_row_of_each_group(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, c), (5, c), (7, d), (7, d + " more"), (7, d), (8, d), (None, None), (None, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
    seven = min((r.h, r.text) for r in docs.where("doc_id = 7").select("text", F.xxhash64("text").alias("h")).collect())[1]
    assert collections.Counter(left) == collections.Counter([(1, a), (None, b), (5, c), (7, seven), (None, None), (None, ""), (9, "")])


def test_pipeline_mix_comes_in_the_order_of_slots(spark):
    docs = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(1_280)], DOCS).repartition(3)
    sources = [r.source for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert len(sources) == 1_280 and all(len(set(sources[i:i + 64])) == 1 and len(set(sources[i:i + 128])) == 2 for i in range(0, 1_280, 128))


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from check import normal
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, sf)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert normal([tuple(r) for r in df.select(*names).collect()]) == normal(rel.fetchall()), name


def test_training_copies_only_clear_features():
    """Training once held all features several times over as 64-bit numbers, 500 MB for 8,000 rows."""
    import tracemalloc

    import pyarrow as pa

    from engram.llm.hashedtext import train

    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 400)
    ids = [np.concatenate([[7 if y else 9], rng.integers(100, 1 << 18, 5_000)]).astype(np.int32).tobytes() for y in label]
    table = pa.table({"label": pa.array(label, pa.int32()), "ids": pa.array(ids, pa.binary()), "weight": pa.array(np.full(400, 0.5), pa.float32()), "head": pa.array(np.full(400, 1), pa.int32())})
    tracemalloc.start()
    weights, thresholds = train(table, 2, 1.0, 50, 1e-5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights[7] > 0 > weights[9] and np.count_nonzero(weights) < 100
    assert peak < 2 * table.nbytes
    again, bars = train(pa.concat_tables([table, table.slice(0, 100)]), 2, 1.0, 50, 1e-5)  # copies teach once
    assert np.array_equal(weights, again) and np.array_equal(thresholds, bars)
