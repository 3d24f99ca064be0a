"""Labels from the words of a group (SC-15, SC-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions.text import capitalize, strings, word_list


def top_words(df: DataFrame, keys: Sequence[str], text: str, k: int, stopwords: Sequence[str] = V.STOPWORDS) -> DataFrame:
    """The ``k`` most frequent content words per group; counts combine before the shuffle."""
    words = (df.select(*keys, F.explode(word_list(F.col(text))).alias("word"))
             .filter(~F.array_contains(strings(stopwords), F.col("word"))))
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_word_label(df: DataFrame, keys: Sequence[str], text: str, k: int = 3) -> DataFrame:
    top = top_words(df.withColumn("_t", F.translate(text, "_", " ")), keys, "_t", k)
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: capitalize(s["word"]))
    return top.groupBy(*keys).agg(F.array_join(words, " ").alias("label"))


def one_new_word_each(names: Column, limit: int = 5) -> Column:
    """From names in order, the first word of each not used before; at most ``limit`` of them."""
    def step(acc: Column, name: Column) -> Column:
        pieces = F.filter(F.split(F.translate(name, "_", " "), r"\s+"),
                          lambda w: (w != "") & ~F.array_contains(acc, F.lower(w)))
        return F.when(F.size(pieces) > 0, F.array_append(acc, F.lower(F.element_at(pieces, 1)))).otherwise(acc)

    words = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.array_join(F.transform(F.slice(words, 1, limit), capitalize), " ")
