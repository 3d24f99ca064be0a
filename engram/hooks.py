"""Places where a caller plugs in code: enrichers, vector providers, context strategies (UDF-01 … UDF-03)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from engram import vocab as V
from engram.functions import text as T
from engram.operators.analytics import strategy_comparison
from engram.operators.packing import fill_in_order

Enricher = Callable[[DataFrame], DataFrame]
Strategy = Callable[[DataFrame], DataFrame]


class Enrichers:
    """Named DataFrame transformations run in order over messages, memories or responses (UDF-01)."""

    def __init__(self) -> None:
        self._by_hook: dict[str, dict[str, Enricher]] = {}

    def register(self, hook: str, name: str, fn: Enricher) -> None:
        self._by_hook.setdefault(hook, {})[name] = fn

    def run(self, hook: str, df: DataFrame) -> DataFrame:
        for fn in self._by_hook.get(hook, {}).values():
            df = df.transform(fn)
        return df


def isolated(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Enricher:
    """An enricher from a pandas function whose failing rows carry the error instead of ending the job.

    ``schema`` lists the added columns. A batch that fails is retried row by row.
    """
    added = ST.StructType.fromDDL(schema)

    def enrich(df: DataFrame) -> DataFrame:
        out = ST.StructType([*df.schema.fields, *added.fields, ST.StructField(f"{name}_error", ST.StringType())])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            try:
                return fn(pdf).assign(**{f"{name}_error": None})
            except Exception as e:  # the error becomes data
                if len(pdf) > 1:
                    return pd.concat([one(pdf.iloc[[i]]) for i in range(len(pdf))])
                return pdf.assign(**{f.name: None for f in added.fields}, **{f"{name}_error": str(e)})

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield one(pdf)[[f.name for f in out.fields]]

        return df.mapInPandas(batches, out)

    return enrich


def question_flag(messages: DataFrame) -> DataFrame:
    return messages.withColumn("is_question", T.is_question(F.col("text")))


def attach_provided_vectors(rows: DataFrame, provider: Callable[[pd.Series], pd.Series], text: str = "content") -> DataFrame:
    """Vectors from a caller's function of a text batch (UDF-02, SRC-10)."""
    embed = F.pandas_udf(provider, "array<double>")
    return rows.withColumn("embedding", embed(F.col(text)))


# ---- context strategies (UDF-03) ------------------------------------------------
def no_memory(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct().withColumn("tokens", F.lit(0).cast("long"))


def raw_history(turns: DataFrame) -> DataFrame:
    """Turns joined by line ends, counted without building the text."""
    chars = F.sum(F.length("text") + 1) - 1
    return turns.groupBy("conv_id").agg(F.greatest(F.lit(1), F.floor(chars / 4)).cast("long").alias("tokens"))


def composed(turns: DataFrame, budget: int = V.COMPOSE_BUDGET) -> DataFrame:
    """Newest turns first while they fit the budget."""
    rows = turns.select("conv_id", "turn", (-F.col("turn")).alias("_o"), T.tokens(F.col("text")).alias("_c"))
    return fill_in_order(rows, "conv_id", "turn", "_o", "_c", budget).select("conv_id", F.col("used_tokens").alias("tokens"))


STRATEGIES: dict[str, Strategy] = {"no_memory": no_memory, "raw_history": raw_history, "composed": composed}


def compare_strategies(turns: DataFrame, strategies: Mapping[str, Strategy] = STRATEGIES) -> DataFrame:
    raw = raw_history(turns).withColumnRenamed("tokens", "raw_tokens")
    return strategy_comparison(raw, {name: build(turns) for name, build in strategies.items()})
