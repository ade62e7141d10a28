"""Scoring formulas as columns, in double."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

K1, B = 1.2, 0.75


def idf(n: float, df: float) -> float:
    """ln((N - df + 0.5) / (df + 0.5) + 1)"""
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, length: Column, idf_value: float, average: float, k1: float = K1, b: float = B, field_boost: float = 1.0) -> Column:
    """idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(average, 1))); 0 where tf is 0.

    field_boost multiplies tf, inside the saturation.
    """
    if field_boost == 0:
        return F.lit(0.0)
    tf = tf * F.lit(float(field_boost)) if field_boost != 1 else tf
    saturated = tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(max(average, 1.0))))
    return F.when(tf > 0, F.lit(idf_value) * saturated).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Combiner:
    """How the scores of a document's values make one score.

    sum, max, avg; log_sum_exp: the mean weighted by softmax(temperature * score);
    weighted_top_k: the k best, weighted by powers of decay, over the sum of the weights.
    """

    kind: str = "max"
    temperature: float = 1.5
    k: int = 5
    decay: float = 0.7

    def __post_init__(self) -> None:
        if self.kind not in ("sum", "max", "avg", "log_sum_exp", "weighted_top_k"):
            raise ValueError(f"unknown combiner {self.kind!r}")
        if not (math.isfinite(self.temperature) and self.temperature > 0 and self.k >= 1 and 0 < self.decay <= 1):
            raise ValueError("a combiner takes a positive temperature, k of 1 or more and a decay in (0, 1]")

    def column(self, scores: Column) -> Column:
        """array<double> -> double; 0 for an empty or null array."""
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        if self.kind == "max":
            out = F.array_max(scores)
        elif self.kind == "sum":
            out = total(scores)
        elif self.kind == "avg":
            out = total(scores) / F.nullif(F.size(scores), F.lit(0))
        elif self.kind == "log_sum_exp":
            weight = lambda s, most: F.exp(F.lit(self.temperature) * (s - most))
            mean = lambda most: total(F.transform(scores, lambda s: weight(s, most) * s)) / total(F.transform(scores, lambda s: weight(s, most)))
            out = F.transform(F.array(F.array_max(scores)), mean)[0]  # the most is bound once: no value looks for it anew
        else:
            best = F.slice(F.reverse(F.array_sort(scores)), 1, self.k)
            weight = lambda i: F.pow(F.lit(self.decay), i.cast("double"))
            out = total(F.transform(best, lambda s, i: s * weight(i))) / F.nullif(total(F.transform(best, lambda s, i: weight(i))), F.lit(0.0))
        return F.coalesce(out, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity; 0 if either norm is (almost) 0."""
    least = 2.0**-23
    mine = dot(vector, vector)
    own = sum(float(x) * float(x) for x in query)
    if own < least:
        return F.lit(0.0)
    return F.when(mine < least, F.lit(0.0)).otherwise(dot(vector, vector_literal(query)) / (F.sqrt(mine) * F.lit(math.sqrt(own))))


def hamming_similarity(words: Column, query: Sequence[int], bits: int) -> Column:
    """1 - differing bits / bits, of codes as arrays of 64-bit words."""
    q = F.array(*[F.lit(x).cast("long") for x in query])
    differ = F.aggregate(F.zip_with(words, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return F.lit(1.0) - differ / F.lit(float(bits))


def sign_bits(vector: Column, bits: int) -> Column:
    """Positive components as bits, in 64-bit words (component 0 is the lowest bit of the first)."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(min(64, bits - 64 * w) - 1)),
        F.lit(0).cast("long"),
        lambda s, i: s.bitwiseOR(F.when(F.get(vector, i + 64 * w) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    return F.array(*[word(w) for w in range(-(-bits // 64))])


def sparse_dot(entries: Column, query: dict[int, float]) -> Column:
    """Sum of products over the dims that entries (array<struct<dim, weight>>) and query share."""
    if not query:
        return F.lit(0.0)
    weights = F.create_map(*[F.lit(x) for d, w in sorted(query.items()) for x in (d, float(w))])
    return F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(F.element_at(weights, e["dim"]), F.lit(0.0)) * e["weight"].cast("double"))
