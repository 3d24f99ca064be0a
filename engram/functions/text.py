"""Column expressions over text: hit counts, word sets, token estimates, shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import vocab as V

WORD = r"[\p{L}\p{N}_]+"
KEYWORD = r"[a-zA-Z][a-zA-Z0-9\-]{2,}"
# Flags that make \w and \b follow Unicode.
ANY_CASE = "(?iU)"


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def strings(values: Sequence[str]) -> Column:
    """A literal string array, typed also when empty."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """A ``when`` chain over a small fixed table; stays inside codegen, needs no join."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def hits(text: Column, vocabulary: Sequence[str]) -> Column:
    """How many distinct vocabulary terms occur in ``text`` as substrings (SC-01)."""
    total = F.lit(0)
    for word in dict.fromkeys(vocabulary):
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def contains_any(text: Column, vocabulary: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in vocabulary:
        found = found | F.contains(text, F.lit(word))
    return found


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of ``piece``."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def split_words(text: Column) -> Column:
    """Whitespace-separated words, none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(split_words(text))


def word_list(text: Column) -> Column:
    """Every word in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_set(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Distinct lower-cased words, optionally without stopwords (SC-14)."""
    words = F.array_distinct(word_list(text))
    return F.array_except(words, strings(stopwords)) if stopwords else words


def keywords(query: Column, stopwords: Sequence[str] = V.STOPWORDS) -> Column:
    """Content words of a query in first-seen order (SC-13)."""
    found = F.regexp_extract_all(F.lower(query), F.lit(KEYWORD), F.lit(0))
    return F.array_except(F.array_distinct(found), strings(stopwords))


def tokens(text: Column) -> Column:
    """Retrieval token estimate: a quarter of the characters, rounded down (SC-12)."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def budget_tokens(text: Column) -> Column:
    """Budget token estimate, never below one (SC-12)."""
    return F.greatest(F.lit(1).cast("long"), tokens(text))


def overlap_coefficient(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared))


def capitalize(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(raised(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def title(text: Column) -> Column:
    return F.initcap(F.translate(text, "_", " "))


def humanize(goal: Column) -> Column:
    named = F.when(F.length(goal) > 0, goal)
    return F.coalesce(capitalize(F.translate(named, "_", " ")), F.lit("General assistance"))


def shorten(text: Column, max_words: int = 6) -> Column:
    """The first words of a text with its first letter raised."""
    short = F.array_join(F.slice(split_words(F.coalesce(text, F.lit(""))), 1, max_words), " ")
    return F.concat(raised(F.substring(short, 1, 1)), F.substring(short, 2, 1 << 30))


def raised(letter: Column) -> Column:
    """The capital of a letter as one character; a letter whose capital would be several takes its single capital, or stays."""
    many = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
    single = {c: c.title() for c in many if len(c.title()) == 1} | {"ß": "ẞ"}
    return F.when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(F.translate(letter, "".join(single), "".join(single.values())))


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters in all, marking the cut with dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def cut_at_space(text: Column, limit: Column | int) -> Column:
    """Cut to ``limit`` characters at the last space before it (SC-22)."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(text, F.lit(1), limit)
    # everything before the last space; the head itself when it has none
    kept = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    cut = F.when(kept != "", F.concat(kept, F.lit("..."))).otherwise(head)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def cut_at_newline(text: Column, limit: Column | int) -> Column:
    """Cut to ``limit`` characters at the last line end before it."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(text, F.lit(1), limit)
    kept = F.regexp_extract(head, r"(?s)^(.+)\n", 1)
    return F.when(F.length(text) > limit, F.when(kept != "", kept).otherwise(head)).otherwise(text)


def is_question(text: Column) -> Column:
    """A question mark and more than four words (SC-21)."""
    return F.contains(text, F.lit("?")) & (n_words(text) > 4)


def concept_groups(text: Column, groups: Mapping[str, Sequence[str]] = V.CONCEPT_GROUPS) -> Column:
    """Names of the keyword groups a text touches (SC-20)."""
    lowered = F.lower(text)
    named = [F.when(contains_any(lowered, words), F.lit(name)) for name, words in groups.items()]
    return F.array_compact(F.array(*named))


def stance_pattern(buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> str:
    """Word-bounded alternation, longest phrase first; plain classes instead of ``\\b``."""
    variants = sorted((v for vs in buckets.values() for v in vs), key=lambda v: (-len(v), v))
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?:^|{edge})({'|'.join(variants)})(?:$|{edge})"


def stance_verb(text: Column, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> Column:
    """The first stance verb in a text, or null (FLT-13)."""
    found = F.regexp_extract(F.lower(text), stance_pattern(buckets), 1)
    return F.when(found != "", found)


def stance_bucket(text: Column, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> Column:
    table = {variant: bucket for bucket, variants in buckets.items() for variant in variants}
    return F.when(stance_verb(text, buckets).isNotNull(), lookup(stance_verb(text, buckets), table, "stance"))


def stable_uuid(text: Column, namespace: str = V.ID_NAMESPACE) -> Column:
    """Name-based (version 5) id in a namespace; a value that already is an id passes through (SC-23)."""
    is_id = text.rlike(r"^(?i)[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")
    bare = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    named = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant,
                     F.substring(digest, 18, 15))
    raw = F.when(is_id, bare).otherwise(named)
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.substring(raw, 13, 4),
                       F.substring(raw, 17, 4), F.substring(raw, 21, 12))
