"""Parsing of already landed external responses (SRC-05 … SRC-09, SRC-19).

A malformed text yields nulls or no rows, never a failed job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions.scoring import weighted_importance
from engram.functions.text import clamp, lookup

_PERMISSIVE = {"mode": "PERMISSIVE"}


def extracted_memories(df: DataFrame, response: str = "response", keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One row per well-formed item of a JSON array of memories; others are dropped (SRC-05)."""
    item = "struct<memory_type:string,content:string,summary:string,importance_score:double>"
    rows = df.select(*keys, F.posexplode(F.from_json(response, f"array<{item}>", _PERMISSIVE)).alias("pos", "m"))
    kind = F.lower(F.col("m.memory_type"))
    return (rows.filter(kind.isin(*V.MEMORY_TYPES) & (F.length("m.content") > 0))
            .select(*keys, "pos", kind.alias("memory_type"), F.col("m.content").alias("content"),
                    F.col("m.summary").alias("summary"),
                    F.coalesce("m.importance_score", F.lit(0.5)).alias("importance_score")))


def normal_trait(raw: Column, values: Mapping[str, Sequence[str]] = V.TRAIT_VALUES) -> Column:
    """Vocabulary form of a trait value: per type an exact hit, then the first substring hit either way (SC-44)."""
    value = F.trim(F.lower(raw))
    out = None
    for known in values.values():
        out = F.when(value.isin(*known), value) if out is None else out.when(value.isin(*known), value)
        for v in known:
            out = out.when(F.contains(F.lit(v), value) | F.contains(value, F.lit(v)), F.lit(v))
    return value if out is None else out.otherwise(value)


def extracted_traits(df: DataFrame, response: str = "response", keys: Sequence[str] = ("user_id",),
                     values: Mapping[str, Sequence[str]] = V.TRAIT_VALUES) -> DataFrame:
    """Trait rows of a six-list JSON object, values normalised, singular types (SRC-06)."""
    item = "array<struct<value:string,confidence:double,reasoning:string>>"
    parsed = df.withColumn("_m", F.from_json(response, f"map<string,{item}>", _PERMISSIVE))
    rows = (parsed.select(*keys, F.explode("_m").alias("category", "items"))
            .filter(F.col("category").isin(*V.TRAIT_CATEGORIES))
            .select(*keys, "category", F.posexplode("items").alias("pos", "t")))
    value = F.replace(F.lower(F.coalesce("t.value", F.lit(""))), F.lit(" "), F.lit("_"))
    return (rows.select(*keys, lookup(F.col("category"), V.TRAIT_CATEGORIES, "").alias("node_type"), "pos",
                        normal_trait(value, values).alias("node_value"),
                        clamp(F.coalesce("t.confidence", F.lit(0.5))).alias("confidence"),
                        F.col("t.reasoning").alias("reasoning"))
            .filter(F.col("node_value") != ""))


def parsed_concept(response: Column) -> Column:
    """Concept struct from JSON, or from the first brace block in the text (SRC-07); null when incomplete."""
    ddl = "struct<name:string,description:string,confidence:double>"
    direct = F.from_json(response, ddl, _PERMISSIVE)
    inner = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), ddl, _PERMISSIVE)

    def whole(c: Column) -> Column:
        return c["name"].isNotNull() & c["description"].isNotNull() & c["confidence"].isNotNull()

    found = F.when(whole(direct), direct).when(whole(inner), inner)
    return F.when(found.isNotNull(), F.struct(found["name"].alias("name"), found["description"].alias("description"),
                                              clamp(found["confidence"]).alias("confidence")))


def parsed_scores(response: Column, memory_type: Column) -> dict[str, Column]:
    """Five clamped scores and importance, with defaults by type when unreadable (SRC-08)."""
    ddl = "struct<" + ",".join(f"{n}:double" for n in V.SCORE_NAMES) + ">"
    parsed = F.from_json(response, ddl, _PERMISSIVE)
    readable = F.try_parse_json(response).isNotNull()
    scores = {}
    for name in V.SCORE_NAMES:
        by_type = lookup(memory_type, {t: d.get(name, 0.50) for t, d in V.TYPE_DEFAULT_SCORES.items()}, 0.50)
        scores[name] = F.when(readable, clamp(F.coalesce(parsed[name], F.lit(0.5)))).otherwise(by_type)
    base = lookup(memory_type, {t: d["base"] for t, d in V.TYPE_DEFAULT_SCORES.items()}, 0.50)
    return {**scores, "importance": F.when(readable, weighted_importance(scores)).otherwise(base)}


def vector(text: Column) -> Column:
    """A vector from its bracketed text: JSON first, comma split otherwise (SRC-09)."""
    pieces = F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ","), lambda x: F.trim(x).try_cast("double"))
    by_split = F.when(~F.exists(pieces, lambda x: x.isNull()), pieces)
    return F.coalesce(F.from_json(text, "array<double>", _PERMISSIVE), by_split)


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def extraction_batches(memories: DataFrame, size: int = 10) -> DataFrame:
    """Request texts for an external extractor: ``size`` rows each, one line per row (SRC-19).

    Batch numbers come from a per-user row number, so one text never exceeds ``size`` lines.
    """
    order = Window.partitionBy("user_id").orderBy("memory_id")
    line = F.concat(F.lit("- "), F.coalesce("summary", F.substring("content", 1, 200)))
    return (memories.select("user_id", "memory_id", line.alias("line"))
            .withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
            .groupBy("user_id", "batch")
            .agg(F.count("*").alias("n_rows"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("memory_id", "line"))),
                                          lambda s: s["line"]), "\n").alias("request_text")))
