"""Relevance and utility columns (SC-30 … SC-40)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from engram import vocab as V
from engram.functions.text import clamp, lookup

DAY = 86400


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; inside a lambda it would be redone per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for missing, empty, unequal or zero vectors. Norms may be precomputed."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) / 1e6 - F.unix_micros(earlier.cast("timestamp")) / 1e6


def whole_days(as_of: Column, moment: Column) -> Column:
    return F.floor(seconds_between(as_of, moment) / DAY)


def linear_recency(as_of: Column, created_at: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - whole_days(as_of, created_at) / 365.0)


def exponential_recency(as_of: Column, anchor: Column, scale_days: float = 90.0) -> Column:
    age = F.greatest(F.lit(0.0), seconds_between(as_of, anchor) / DAY)
    return F.coalesce(F.exp(-age / scale_days), F.lit(0.5))


def retrieval_score(similarity: Column, importance: Column, recency: Column, reinforcements: Column,
                    strength: Column) -> Column:
    """Similarity, importance, recency and reinforcement in fixed proportions (SC-33)."""
    known = F.when(importance > 0, importance).otherwise(0.5)
    reinforced = F.least(F.lit(1.0), F.coalesce(reinforcements, F.lit(0)) * 0.1 * F.coalesce(strength, F.lit(0.0)))
    return similarity * 0.40 + known * 0.30 + recency * 0.15 + reinforced * 0.15


#: Bytes that are no part of a word become spaces.
_APART = bytes(i if i >= 128 or chr(i).isalnum() or chr(i) in "_-" else 32 for i in range(256))


@F.arrow_udf(ArrayType(BooleanType()))
def contained(texts: pa.Array, items: pa.Array) -> pa.Array:
    """For each of ``items``, which are lists of words, whether the text contains one of its words; a null contains none.

    Four bytes in a row of a word must be somewhere in the text; what passes is looked up among the different words of the text or searched for in them, and in the text if it is more than a word, so it is exact.
    """
    lists = items.flatten()
    coded = lists.flatten().dictionary_encode()
    codes, terms = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), [str(w).encode() for w in coded.dictionary.to_pylist()]

    def bounds(a: pa.Array) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def fours(b: bytes) -> np.ndarray:
        x = np.frombuffer(b, np.uint8).astype(np.uint16)
        return ((x[:-3] * 41 + x[1:-2]) * 41 + x[2:-1]) * 41 + x[3:]

    one = [w.translate(_APART) == w and b" " not in w for w in terms]
    item, word = bounds(items), bounds(lists)
    known, hit, out = None, np.zeros(len(terms) + 1, bool), []
    for text, i, j in zip(texts.to_pylist(), item, item[1:]):
        mine, ends = codes[word[i]:word[j]], word[i:j + 1] - word[i]
        if text is None or not len(mine):
            out.append(np.zeros(j - i, bool))
            continue
        if known is None or not (np.array_equal(mine, known[0]) and np.array_equal(ends, known[1])):  # rows of a user come together
            some = np.unique(mine[mine >= 0]).tolist()
            short = [c for c in some if len(terms[c]) < 4]
            long = np.array([c for c in some if len(terms[c]) >= 4], np.int64)
            parts = [fours(terms[c]) for c in long]
            known = mine, ends
            asked, first = np.concatenate([np.zeros(0, np.uint16), *parts]), np.cumsum([0, *map(len, parts)])[:-1]
        b, maybe = text.encode(), short
        if len(long) and len(b) >= 4:
            seen = np.zeros(1 << 16, bool)
            seen[fours(b)] = True
            maybe = short + long[np.logical_and.reduceat(seen[asked], first)].tolist()
        words = set(b.translate(_APART).split())
        said = b" ".join(words)
        found = [c for c in maybe if terms[c] in words or terms[c] in (said if one[c] else b)]
        hit[found] = True  # the last place stands for nulls and stays false
        n = np.concatenate([[0], np.cumsum(hit[mine])])
        out.append(n[ends[1:]] > n[ends[:-1]])
        hit[found] = False
    return pa.ListArray.from_arrays(pa.array(item.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, bool), *out])))


def topic_words(category: Column) -> Column:
    """The phrase of a topic and its words."""
    phrase = F.translate(category, "_", " ")
    return F.concat(F.array(phrase), F.split(phrase, " "))


def goal_alignment(content: Column, memory_type: Column, keywords: Column, required: Column, hits: tuple[Column, Column] | None = None) -> Column:
    """Shares of query keywords and of required topics found in the text (SC-34). ``hits`` are how many of both, where that is known."""
    def shares(kw_hits: Column, topic_hits: Column) -> Column:
        kw = F.when(F.size(keywords) > 0, kw_hits / F.size(keywords)).otherwise(0.0)
        topics = F.when(F.size(required) > 0, topic_hits / F.size(required)).otherwise(0.0)
        return kw * 0.6 + topics * 0.4

    def searched(text: Column) -> Column:
        has = lambda w: F.contains(text, w)
        return shares(F.size(F.filter(keywords, has)), F.size(F.filter(required, lambda c: F.exists(topic_words(c), has))))

    both = bind(F.lower(content), searched) if hits is None else shares(*hits)
    return clamp(both + F.when(memory_type == "procedural", 0.15).otherwise(0.0))


def _matched_share(items: Column, matches) -> Column:
    """Confidence of the matching items over that of all items."""
    def add(acc: Column, item: Column) -> Column:
        weight = F.coalesce(item["confidence"], F.lit(0.5))
        return F.struct((acc["all"] + weight).alias("all"),
                        (acc["hit"] + F.when(matches(item), weight).otherwise(0.0)).alias("hit"))

    start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("hit"))
    return F.aggregate(items, start, add, lambda a: F.when(a["all"] > 0, a["hit"] / a["all"]).otherwise(0.0))


def trait_terms(value: Column) -> Column:
    """The lowered form that trait matching looks for."""
    return F.lower(F.coalesce(value, F.lit("")))


def concept_terms(name: Column) -> tuple[Column, Column]:
    """(lowered phrase, its words over three letters) that concept matching looks for."""
    phrase = F.lower(F.translate(F.coalesce(name, F.lit("")), "_", " "))
    return phrase, F.filter(F.split(phrase, r"\s+"), lambda w: F.length(w) > 3)


def trait_words(trait: Column) -> Column:
    """What names a trait (``term`` struct) in a text."""
    return F.filter(F.array(trait["term"]), lambda w: w != "")


def concept_words(concept: Column) -> Column:
    """What names a concept (``term, parts`` struct) in a text."""
    return F.when(concept["term"] != "", F.concat(F.array(concept["term"]), concept["parts"])).otherwise(F.array().cast("array<string>"))


def _named_share(content: Column, items: Column, words, hits: Column | None) -> Column:
    if hits is not None:
        return _matched_share(F.zip_with(items, hits, lambda x, h: F.struct(x["confidence"].alias("confidence"), h.alias("hit"))), lambda x: x["hit"])
    return bind(F.lower(content), lambda text: _matched_share(items, lambda x: F.exists(words(x), lambda w: F.contains(text, w))))


def identity_alignment(content: Column, memory_type: Column, traits: Column, hits: Column | None = None) -> Column:
    """Confidence share of the traits (``term, confidence`` structs) named in the text (SC-35). ``hits`` are which are named, where that is known."""
    share = _named_share(content, traits, trait_words, hits)
    own = memory_type == "identity"
    return F.when(F.coalesce(F.size(traits), F.lit(0)) <= 0, F.when(own, 0.5).otherwise(0.3)).otherwise(
        clamp(share + F.when(own, 0.2).otherwise(0.0)))


def concept_relevance(content: Column, memory_type: Column, concepts: Column, hits: Column | None = None) -> Column:
    """Confidence share of the concepts (``term, parts, confidence`` structs) named in the text (SC-36). ``hits`` are which are named, where that is known."""
    share = _named_share(content, concepts, concept_words, hits)
    own = memory_type == "concept"
    return F.when(F.coalesce(F.size(concepts), F.lit(0)) <= 0, F.when(own, 0.4).otherwise(0.2)).otherwise(
        clamp(share + F.when(own, 0.15).otherwise(0.0)))


def known_importance(importance: Column) -> Column:
    return F.when(importance != 0, importance).otherwise(0.5)


def reinforcement_blend(reinforcement_score: Column, strength: Column) -> Column:
    return clamp((F.coalesce(reinforcement_score, F.lit(0.5)) + F.coalesce(strength, F.lit(0.5))) / 2)


def stability(strength: Column, decay_rate: Column) -> Column:
    steady = 1.0 - F.least(F.lit(1.0), F.coalesce(decay_rate, F.lit(0.05)) * 5)
    return clamp((F.coalesce(strength, F.lit(0.5)) + steady) / 2)


def type_multiplier(memory_type: Column) -> Column:
    return 0.85 + 0.15 * lookup(memory_type, V.TYPE_PRIORITY, 0.6)


def utility(dims: Mapping[str, Column], memory_type: Column,
            weights: Mapping[str, float] = V.UTILITY_WEIGHTS) -> Column:
    """Weighted dimensions times the type multiplier (SC-39). Weights may be overridden."""
    total = None
    for name in V.UTILITY_WEIGHTS:
        part = dims[name] * weights[name]
        total = part if total is None else total + part
    return clamp(total * type_multiplier(memory_type))


def selection_reason(dims: Mapping[str, Column], weights: Mapping[str, float] = V.UTILITY_WEIGHTS) -> Column:
    """The two heaviest contributions above the noise floor, in words (SC-40)."""
    parts = [F.struct((-dims[n] * weights[n]).alias("c"), F.lit(i).alias("i"), dims[n].alias("d"),
                      F.lit(V.REASON_LABELS[n]).alias("label")) for i, n in enumerate(V.UTILITY_WEIGHTS)]
    top = F.filter(F.slice(F.array_sort(F.array(*parts)), 1, 2), lambda p: p["d"] > 0.15)
    named = F.array_join(F.transform(top, lambda p: p["label"]), " and ")
    return F.concat(F.lit("Selected because it "),
                    F.when(named != "", named).otherwise("provides general supporting context"), F.lit("."))
