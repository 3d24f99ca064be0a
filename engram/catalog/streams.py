"""Scheduled work as batch queries (ST-01 … ST-09); tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog.registry import query, r6
from engram.catalog.relevance import understood
from engram.catalog.texts import IMPORTANCE, LEX, SCORED
from engram.catalog.views import as_of
from engram.streaming import jobs as J
from engram.streaming import state as ST


def _turns_sql() -> str:
    source = "(SELECT conv_id * 1000000 + turn AS memory_id, user_id, 'episodic' AS memory_type, text AS content FROM turns_v)"
    return SCORED.replace("FROM memories_v", f"FROM {source}")


@query("st_01", f"SELECT memory_id, ROUND({IMPORTANCE}, 6) AS importance_score FROM ({_turns_sql()})")
def st_01(t):
    df = J.score_turns(t.turns_v.withColumn("memory_type", F.lit("episodic")), LEX)
    return df.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("memory_id"), r6("importance_score").alias("importance_score"))


@query("st_02", "SELECT (ts_s // 3600) * 3600 AS hour_s, user_id, COUNT(*) AS n FROM activity_v GROUP BY 1, 2")
def st_02(t):
    return J.hourly_users(t.activity_v).select(F.unix_timestamp("hour").alias("hour_s"), "user_id", "n")


@query("st_03", "SELECT DISTINCT user_id FROM memories_v WHERE cognitive_state <> 'forgotten'")
def st_03(t):
    return J.users_to_sweep(t.memories_v)


@query("st_04", """
    SELECT user_id, MIN(ts_s) AS started_s, MAX(ts_s) + 900 AS idle_s, COUNT(*) AS n FROM (
      SELECT *, SUM(CAST(ts_s - prev >= 900 OR prev IS NULL AS INT)) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS s FROM (
        SELECT *, LAG(ts_s) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS prev FROM activity_v)) GROUP BY user_id, s""")
def st_04(t):
    df = J.sessions(t.activity_v)
    return df.select("user_id", F.unix_timestamp("started").alias("started_s"), F.unix_timestamp("idle_from").alias("idle_s"), "n")


@query("st_06", """SELECT (ts_s // 3600) * 3600 AS start_s, user_id % 10 AS shard, COUNT(*) AS n, ROUND(COUNT(*) / 3600.0, 6) AS rate, ROUND(AVG(CAST(event_type = 'error' AS DOUBLE)), 6) AS error_ratio FROM activity_v GROUP BY 1, 2""")
def st_06(t):
    df = J.service_rates(t.activity_v.withColumn("shard", F.col("user_id") % 10), "shard", "1 hour", None)
    return df.select(F.unix_timestamp("start").alias("start_s"), "shard", "n", r6("rate").alias("rate"), r6("error_ratio").alias("error_ratio"))


@query("st_06_sliding", """SELECT s * 60 AS start_s, event_type, COUNT(*) AS n FROM (SELECT event_type, UNNEST(RANGE(ts_s // 60 - 4, ts_s // 60 + 1)) AS s FROM activity_v) GROUP BY 1, 2""")
def st_06_sliding(t):
    return J.service_rates(t.activity_v).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


@query("st_07", """
    SELECT memory_id, n, ROUND(s, 6) AS memory_strength, c AS reinforcement_count, ROUND(decay_rate * POW(0.8, n), 8) AS decay_rate,
      CASE WHEN s >= 0.85 AND c >= 3 THEN 'active' WHEN s >= 0.70 AND c >= 2 THEN 'reinforced' WHEN c >= 5 AND s >= 0.60 THEN 'semantic_candidate'
        WHEN s < 0.30 THEN 'decaying' WHEN c >= 4 THEN 'semantic_candidate' ELSE 'reinforced' END AS cognitive_state
    FROM (SELECT m.memory_id, n, decay_rate, LEAST(1.0, COALESCE(memory_strength, 0.5) + 0.1 * n) AS s, reinforcement_count + n AS c
      FROM memories_v m JOIN (SELECT memory_id, COUNT(DISTINCT event_id) AS n FROM activity_v WHERE event_type = 'click' GROUP BY memory_id) e ON e.memory_id = m.memory_id)""")
def st_07(t):
    df = J.running_reinforcement(t.activity_v.filter("event_type = 'click'"), t.memories_v)
    return df.select("memory_id", "n", r6("memory_strength").alias("memory_strength"), "reinforcement_count", F.round("decay_rate", 8).alias("decay_rate"), "cognitive_state")


@query("st_07_state", """
    WITH RECURSIVE d AS MATERIALIZED (SELECT e.memory_id, e.day, e.n, COALESCE(memory_strength, 0.5) AS s0, COALESCE(reinforcement_count, 0) AS c0, COALESCE(decay_rate, 0.05) AS r0,
        row_number() OVER (PARTITION BY e.memory_id ORDER BY day) AS pos, lead(day) OVER (PARTITION BY e.memory_id ORDER BY day) AS ahead
      FROM (SELECT memory_id, CAST(ts_s // 86400 AS BIGINT) AS day, COUNT(DISTINCT event_id) AS n FROM activity_v WHERE event_type = 'click' GROUP BY 1, 2) e JOIN memories_v m ON m.memory_id = e.memory_id),
    f AS (SELECT memory_id, pos, day, n, ahead, LEAST(1.0, s0 + 0.1 * n) AS s, c0 + n AS c, r0 * POW(0.8, n) AS r FROM d WHERE pos = 1
      UNION ALL SELECT d.memory_id, d.pos, d.day, d.n, d.ahead, LEAST(1.0, f.s * POW(1 - f.r, GREATEST(0, d.day - f.day - 1)) + 0.1 * d.n), f.c + d.n, f.r * POW(0.8, d.n)
        FROM f JOIN d ON d.memory_id = f.memory_id AND d.pos = f.pos + 1),
    a AS (SELECT memory_id, day, n, s, c, r FROM f UNION ALL SELECT memory_id, day + 3, 0, s * POW(1 - r, 3), c, r FROM f WHERE ahead > day + 3)
    SELECT memory_id, CAST(day AS INTEGER) AS day, n, ROUND(s, 6) AS memory_strength, c AS reinforcement_count, ROUND(r, 8) AS decay_rate,
      CASE WHEN s >= 0.85 AND c >= 3 THEN 'active' WHEN s >= 0.70 AND c >= 2 THEN 'reinforced' WHEN c >= 5 AND s >= 0.60 THEN 'semantic_candidate'
        WHEN s < 0.30 THEN 'decaying' WHEN c >= 4 THEN 'semantic_candidate' ELSE 'reinforced' END AS cognitive_state FROM a""")
def st_07_state(t):
    df = ST.running_state(t.activity_v.filter("event_type = 'click'"), t.memories_v)
    return df.select("memory_id", "day", "n", r6("memory_strength").alias("memory_strength"), "reinforcement_count", F.round("decay_rate", 8).alias("decay_rate"), "cognitive_state")


@query("st_08")
def st_08(t):
    df = J.revivals(understood(t), t.memories_v, t.traits_v, t.concepts_v, as_of(), 0.35)
    return df.select("memory_id", "user_id", "query_id", "old_state", "new_state", r6("new_strength").alias("new_strength"), "revival_count")


@query("st_09", """SELECT tenant_id, CAST(DATE_TRUNC('month', make_timestamp(CAST(ts_s AS BIGINT) * 1000000)) AS DATE) AS month, COUNT(*) AS uses, COUNT(*) > 200 AS breached
    FROM (SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS tenant_id, ts_s FROM activity_v WHERE event_type = 'purchase') GROUP BY 1, 2""")
def st_09(t):
    return J.monthly_counts(t.activity_v.filter("event_type = 'purchase'").withColumn("tenant_id", F.floor(F.col("user_id") / 15)))


@query("st_09_cap", """
    WITH c AS MATERIALIZED (SELECT tenant_id, CAST(DATE_TRUNC('month', make_timestamp(CAST(ts_s AS BIGINT) * 1000000)) AS DATE) AS month, COUNT(*) AS uses
      FROM (SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS tenant_id, ts_s FROM activity_v WHERE event_type = 'purchase') GROUP BY 1, 2)
    SELECT tenant_id, month, uses, uses > 20 AS breached, true AS closed FROM c UNION ALL SELECT tenant_id, month, 21, true, false FROM c WHERE uses > 20""")
def st_09_cap(t):
    return ST.monthly_cap(t.activity_v.filter("event_type = 'purchase'").withColumn("tenant_id", F.floor(F.col("user_id") / 15)), cap=20)


@query("st_09_daily", """SELECT h * 3600 AS start_s, tenant_id, COUNT(*) AS n FROM (SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS tenant_id, UNNEST(RANGE(ts_s // 3600 - 23, ts_s // 3600 + 1)) AS h
    FROM activity_v WHERE event_type = 'signup') GROUP BY 1, 2 HAVING COUNT(*) >= 5""")
def st_09_daily(t):
    tries = t.activity_v.filter("event_type = 'signup'").withColumn("tenant_id", F.floor(F.col("user_id") / 15))
    return J.daily_attempts(tries, "tenant_id").select(F.unix_timestamp("start").alias("start_s"), "tenant_id", "n")


@query("src_04", """SELECT m.memory_id, COALESCE(LEN(v.embedding), 0) AS n_dims FROM memories_v m LEFT JOIN vectors_v v ON v.memory_id = m.memory_id WHERE importance_score >= 0.3""")
def src_04(t):
    """Write memories and vectors as two tables into the checkpoint folder and read them back."""
    import uuid
    from engram.session import shared_folder
    from engram.sources import store
    root = f"{shared_folder(t.spark)}/pairs-{uuid.uuid4().hex}"
    kept = t.memories_v.filter("importance_score >= 0.3")
    store.write_pairs(kept.select("memory_id", "user_id", "content", "importance_score"), t.vectors_v.select("memory_id", "embedding"), root)
    back = store.attach_vectors(store.read_table(t.spark, root, "memories"), store.read_table(t.spark, root, "memory_embeddings"))
    return back.select("memory_id", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("n_dims"))


@query("src_10", """SELECT m.memory_id, LEN(v.embedding) AS n_dims FROM memories_v m JOIN vectors_v v ON v.memory_id = m.memory_id""")
def src_10(t):
    from engram.sources.store import attach_vectors
    return attach_vectors(t.memories_v, t.vectors_v).filter("embedding IS NOT NULL").select("memory_id", F.size("embedding").alias("n_dims"))
