"""Spelling variants by permuterm rotations.

A word with its terminator is turned into all its rotations. An edit at one place lies at the end of one of them: two words that differ by a replacement
share a rotation up to its last character, and a word with one character more has a rotation that goes one character past a
rotation of the other. So rotations are sorted under the prefix that skips the edited character; a group is one whole
rotation (of one word at most) and those that go one character past it, one for each last character. Groups are thus no larger than the
alphabet, whatever the words. A scan of a sorted group gives each member the number of its near words there and the best of
them; pairs are never written. An indel inside a run of equal characters has a group for each place of the run and counts at the first.

Words are counted in tasks before they are shuffled, so a word of every text is one row per task. Null texts and texts
without letters have no words. A null key is the empty text, repeated rows count again. Of equally frequent near words the smaller in
code-point order is the form. Words that are null or hold the terminator take no part. Empty tables give no rows. Columns of the input other than those named are
not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import slices
from engram.session import cut

#: Different words a task counts before it passes the counts on.
COUNTED = 1 << 18
#: The terminator; no run of letters holds it.
MARK = "\x00"


def word_counts(docs: DataFrame, key: str, text: str, least: int = 6, every: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least ``least`` code points occurs in whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. With ``every``, a run for which the crc32 of ``key:run`` is
    divisible by it loses the code point at that crc32 modulo its length.
    """
    asked = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % max(least, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array(totals.keys(), pa.binary()).cast(pa.string())
            counts = pa.array(totals.values(), pa.int64())
            totals.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                keys, texts = batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
                for name, raw in zip(keys, texts):
                    if not raw:
                        continue
                    start = crc32(f"{'' if name is None else name}:".encode())
                    for word, n in Counter(runs.findall(raw.lower())).items():
                        if every and (h := crc32(word, start)) % every == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            letters = letters[:at] + letters[at + 1:]
                            if len(letters) < least:
                                continue
                            word = letters.encode()
                        totals[word] = totals.get(word, 0) + n
                    if len(totals) >= COUNTED:
                        yield flush()
        if totals:
            yield flush()

    return asked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, past, first): each whole rotation of a marked word (``past`` false), and each without its last character where that is a letter.

    ``first`` says that the letter before the skipped one differs from it.
    """
    length = F.char_length("word")
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.concat(F.substring("word", i + 1, length), F.lit(MARK), F.substring("word", F.lit(1), i)).alias("prefix"), F.lit(False).alias("past"), F.lit(False).alias("first")))
    past = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(
        F.concat(F.substring("word", i + 1, length), F.lit(MARK), F.substring("word", F.lit(1), i - 1)).alias("prefix"), F.lit(True).alias("past"),
        ((i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))).alias("first")))
    return words.select("word", "n", F.explode(F.concat(whole, past)).alias("r")).select("r.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): for each word of (word, n) that has one, how many words are one inserted, deleted or replaced code point away,
    and the most frequent of them as (word, n)."""
    group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct(F.col("word"), F.col("n"))
    scanned = (rotations(words)
               .withColumns({"place": F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "word")),
                             "pasts": F.sum(F.col("past").cast("long")).over(group), "firsts": F.sum(F.col("first").cast("long")).over(group),
                             "members": F.count(F.lit(1)).over(group), "best": F.first(one).over(group), "second": F.nth_value(one, 2).over(group)})
               .where("members > 1"))
    here = F.when(~F.col("past"), F.col("firsts")).otherwise(F.col("pasts") - 1 + F.when(F.col("first"), F.col("members") - F.col("pasts")).otherwise(0))
    seen = scanned.select("word", here.alias("here"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best")).alias("near"))
    best = F.min(F.struct((-F.col("near.n")).alias("m"), F.col("near.word").alias("w")))
    return (seen.groupBy("word").agg(F.sum("here").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.struct(F.col("b.w").alias("word"), (-F.col("b.m")).alias("n")).alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word of (word, form) ends when forms are followed. Forms get more frequent with each step, so there is no ring.

    Every round doubles the steps that are taken.
    """
    ends = cut(forms.select("word", F.col("form").alias("root")))
    while not ends.join(ends.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut(ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return ends


def spelling_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words of (word, n).

    The form of a word is its most frequent near word if that is at least ``ratio`` times as frequent, the root what forms lead to.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    sound = cut(words.select("word", "n").where(F.col("word").isNotNull() & ~F.contains("word", F.lit(MARK))))
    leads = F.col("near.n") >= ratio * F.col("n")
    formed = cut(sound.join(near_words(sound), "word", "left").select(
        "word", F.when(leads, F.col("near.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("near.n")).alias("form_n")))
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
