"""Vector and score functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

#: Below these, a norm and a mask's size count as zero.
NORM_FLOOR, MASK_FLOOR = 1e-12, 1e-12


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the places that both have."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v at length 1; a (nearly) zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > NORM_FLOOR, F.transform(v, lambda x: x.cast("double") / n)).otherwise(as_doubles(v)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > NORM_FLOOR, dot(a, b) / n).otherwise(0.0)


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction of two arrays of vectors: each query vector's best match, summed; 0 if a side is empty."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), total(best)).otherwise(0.0)


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of (term, weight); repeated terms add up, disjoint ones give 0."""
    return total(F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["term"] == x["term"]), lambda y: y["weight"].cast("double") * x["weight"].cast("double")))))


def sparse_top(v: Column, k: int) -> Column:
    """The k largest weights of an array of (term, weight), largest first, ties by term; all of a shorter one as it is."""
    by = F.transform(v, lambda x: F.struct((-x["weight"].cast("double")).alias("w"), x["term"].alias("t"), x["weight"].alias("o")))
    cut = F.transform(F.slice(F.array_sort(by), 1, k), lambda x: F.struct(x["t"].alias("term"), x["o"].alias("weight")))
    return F.when(F.size(v) > k, cut).otherwise(v)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x.cast("double")))


def yes_no_score(yes: Column, no: Column) -> Column:
    return sigmoid(yes.cast("double") - no.cast("double"))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def log_softmax(v: Column) -> Column:
    """Shifted by the maximum; zeros if that is not finite."""
    zeros = F.transform(v, lambda x: F.lit(0.0))
    log = lambda top: F.ln(total(F.transform(v, lambda x: F.exp(x.cast("double") - top))))
    shifted = lambda top: let(log(top) + top, lambda s: F.transform(v, lambda x: x.cast("double") - s))
    return let(F.array_max(as_doubles(v)), lambda top: F.when(_finite(top), shifted(top)).otherwise(zeros))


def softmax(v: Column) -> Column:
    e = let(F.array_max(as_doubles(v)), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return let(F.struct(e.alias("e"), total(e).alias("s")), lambda p: F.when(p["s"] > 0, F.transform(p["e"], lambda x: x / p["s"])).otherwise(F.transform(p["e"], lambda x: F.lit(0.0))))


def class_confidence(v: Column, k: Column) -> Column:
    """Entry k (from 0) of a row of probabilities, or of its softmax where it is no such row."""
    d = as_doubles(v)
    is_prob = (F.abs(total(d) - 1.0) < 0.05) & F.forall(d, lambda x: (x >= -0.01) & (x <= 1.01))
    at = (k + 1).cast("int")
    return F.when(is_prob, F.element_at(d, at)).otherwise(F.element_at(softmax(v), at))


def argmax_first(v: Column) -> Column:
    """Index (from 0) of the maximum, the lowest of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmax_last(v: Column) -> Column:
    return (F.size(v) - F.array_position(F.reverse(v), F.array_max(v))).cast("int")


def relative_l2_error(candidate: Column, reference: Column) -> Column:
    """Distance of a candidate row over the reference's norm (1e-6 at least)."""
    d = F.zip_with(candidate, reference, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d) / F.greatest(norm(reference), F.lit(1e-6))


#: Relative error up to which two runs of a model agree.
AGREES = 0.2


def probe_agrees(candidates: Column, references: Column) -> Column:
    """Whether the worst row of two arrays of vectors is within AGREES."""
    worst = F.array_max(F.zip_with(candidates, references, relative_l2_error))
    return F.coalesce(worst <= AGREES, F.lit(True))


def greedy_ids(steps: Column, end_id: int, most: int) -> Column:
    """Ids of the best class of each step (of rows of scores) up to the end id, which is kept, or most steps."""
    ids = F.transform(F.slice(steps, 1, most), argmax_first)
    end = F.array_position(ids, end_id).cast("int")
    return F.when(end > 0, F.slice(ids, F.lit(1), end)).otherwise(ids)


def fact_margin(logit: Column, threshold: Column, offset: Column, relation_offset: Column) -> Column:
    return logit - (threshold + offset) + relation_offset


def confidence_score(kind: Column, value: Column) -> Column:
    """1 where the output is deterministic, else the measured or derived value."""
    return F.when(kind == "deterministic", 1.0).otherwise(value.cast("double"))


def derived_confidence(clean: Column, repetition: Column, divergence: Column, length_ratio: Column) -> Column:
    c = F.when(clean, 1.0).otherwise(0.5) * (1.0 - repetition) * (1.0 - divergence)
    c = c * F.when(length_ratio.isNull() | length_ratio.between(0.5, 2.0), 1.0).otherwise(0.7)
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def backoff_ms(initial: Column, attempt: Column) -> Column:
    """initial doubled with every attempt after the first."""
    return (initial * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")
