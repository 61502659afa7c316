"""Column functions: term-frequency weights, probabilities, phonetic codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL, MATCH = 1, 2


def probability(weight: Column, base: str = "e") -> Column:
    """Of a log Bayes factor; neither end overflows."""
    weight = weight * F.log(F.lit(2.0)) if base == "2" else weight
    small = F.exp(-F.abs(weight))
    return F.when(weight >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def tf_weight(u: Column, denominator: Column, weight: Column | float = 1.0, base: str = "e") -> Column:
    ratio = u / denominator
    return (F.log2(ratio) if base == "2" else F.log(ratio)) * weight


def tf_denominator(a: Column, b: Column, exact: bool) -> Column:
    return (a + b) / 2 if exact else F.greatest(a, b)


def log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def soundex(c: Column, strict: bool = False) -> Column:
    """Soundex code. strict: H and W don't join a first letter with a later one of its class, so SHSA is S200."""
    plain = F.soundex(c)
    if not strict:
        return plain
    up = F.upper(c)
    groups = "BFPV CGJKQSXZ DT L MN R".split()
    apart = F.lit(False)
    for g in groups:
        apart = apart | up.rlike(f"^[{g}][HW]+[{g}]")
    # a vowel in place of the H or W parts the two letters
    return F.when(apart, F.soundex(F.regexp_replace(up, "^(.)[HW]+", "$1A"))).otherwise(plain)
