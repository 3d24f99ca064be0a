"""Registered queries of the subpackage over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bitsliced, bpe, covertree, crosspolytope, linededup, minhash, mixing, packing, quality, ring, suffixes, toxicity, variants
from engram.llm.common import table
from engram.llm.hashedtext import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern).select("doc_id", "ids")
    return bpe.decode(ids, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_bit_sliced_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", bitsliced.every(50), 5)


@query("op9_cross_polytope")
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", crosspolytope.every(50), 5)


@query("op2_bounded_load_ring")
def op2_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(table(spark, sf_dir, "documents"), 40)


LINE_KEY = "trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op6_line_dedup", f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    k AS (SELECT doc_id, unnest(list_distinct(list_transform(ls, lambda x: {LINE_KEY}))) AS line_key FROM d),
    hot AS (SELECT line_key, max(doc_id) AS last FROM k WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(*) >= 3),
    g AS (SELECT doc_id, list(line_key) AS gone FROM k JOIN hot USING (line_key) WHERE doc_id <> last GROUP BY doc_id),
    r AS (SELECT doc_id, len(ls) AS n_lines, CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(gone, {LINE_KEY})) END AS kept
          FROM d LEFT JOIN g USING (doc_id))
    SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(kept) AS BIGINT) AS n_dropped,
      sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM r""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.with_scores(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_bottom_k_near_dedup")
def op4_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


@query("op3_bucket_pointer_dedup")
def op3_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_pfair_mix")
def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op7_ordinal_quality")
def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    graded = quality.with_grades(docs, labels, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2), 3)
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")


@query("op13_vector_bin_packing")
def op13_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of a document bear loss."""
    docs = packing.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, "doc_id", tokens=4096, segments=64, loss=4096).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def lloyd_sql(rounds: int) -> str:
    """Rounds of assignment and of means written out one after the other."""
    near = """SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(w) AS w FROM (
        SELECT p.*, b.entry, CAST(list_sum(list_transform(list_zip(p.w, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d
        FROM p JOIN b{0} b USING (part)) GROUP BY vec_id, label, part"""
    means = """SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN (
        SELECT part, entry, list(c ORDER BY i) AS c FROM (
            SELECT part, entry, i, CAST(floor(sum(CAST(w[i] AS DOUBLE)) / count(*)) AS BIGINT) AS c FROM a{0}, unnest(range(1, len(w) + 1)) AS u(i) GROUP BY part, entry, i)
        GROUP BY part, entry) m USING (part, entry)"""
    steps = ", ".join(f"a{r} AS MATERIALIZED ({near.format(r)}), b{r + 1} AS MATERIALIZED ({means.format(r)})" for r in range(rounds))
    return f"""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
               WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, label, part, w[part * (len(w) // 8) + 1 : (part + 1) * (len(w) // 8)] AS w FROM v, unnest(range(8)) AS u(part)),
    b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w AS c FROM p
                        JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16) USING (vec_id)),
    {steps}, f AS MATERIALIZED ({near.format(rounds)}),
    r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


@query("op11_cover_tree_lloyd", lloyd_sql(6))
def op11_cover_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, scale=4096)


@query("op12_permuterm_variants", r"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS t(i))),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY doc_id, run),
    bytes AS (SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs),
    hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i:
          16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
    w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    d AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
    indel AS (SELECT DISTINCT d.word AS long, w.word AS short, d.n AS long_n, w.n AS short_n FROM d JOIN w ON w.word = d.rest),
    pairs AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION ALL SELECT long, short, short_n FROM indel UNION ALL SELECT short, long, long_n FROM indel),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
    f AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
          FROM w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN f ON f.word = c.next)
    SELECT f.word, form, c.at AS root, n, n_near, form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL""")
def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text", least=6, every=199)
    return variants.spelling_groups(words.where("n >= 5"), ratio=5)
