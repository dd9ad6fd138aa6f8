"""Small Column helpers used by several operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy_number(*cols: Column) -> Column:
    """First value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0))


def truthy_text(*cols: Column) -> Column:
    """First value that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _split(value):
    """High and low half of a double, exact in sum (Veltkamp); works on columns and on plain floats."""
    scaled = value * 134217729.0
    high = scaled - (scaled - value)
    return high, value - high


def round_binary(col: Column, digits: int) -> Column:
    """Rounding of the double's exact binary value, ties to even, as C and Python round.

    Spark's own rounding works on the shortest decimal text, so 2.675 would count as a tie although the double
    lies below it. Here the distance to the midpoint is computed with its rounding error (a two-product).
    """
    x = col.cast("double")
    if digits == 0:
        return F.rint(x)
    scale = 2.0 * 10**digits
    high, low = _split(x)
    scale_high, scale_low = _split(scale)
    product = x * scale
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    below = F.floor(product / 2).cast("double")
    side = (product - (below * 2 + 1)) + error
    odd = (below % 2) != 0
    return F.when((side > 0) | ((side == 0) & odd), below + 1).otherwise(below) / float(10**digits)


def exact_mean(col: Column, digits: int) -> Column:
    """Mean of values with that many digits; summed as decimals, so the order of the rows cannot change it."""
    return F.sum(col.cast(f"decimal(18,{digits})")).cast("double") / F.count(col)


def clamp(col: Column, low, high) -> Column:
    """`col` kept within the bounds; null stays null, which `least` and `greatest` alone would not give."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def one_of(cond_values: Sequence[tuple[Column, object]], default=None) -> Column:
    """Ordered rule list: value of the first condition that is true."""
    chain = None
    for cond, value in cond_values:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    if chain is None:
        return F.lit(default)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """Regex search by any of the patterns; no patterns means no restriction."""
    result = None
    for pattern in patterns:
        hit = col.rlike(pattern)
        result = hit if result is None else (result | hit)
    return F.lit(True) if result is None else F.coalesce(result, F.lit(False))


def regex_group(col: Column, pattern: str, group: int) -> Column:
    """One group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def mapping(pairs: dict[str, object]) -> Column:
    """A literal map column for a small fixed table."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def band(share: Column) -> Column:
    """Traffic-light band of a share of a limit."""
    return one_of([(share >= 0.90, "red"), (share >= 0.70, "amber")], "green")


def verdict(score: Column) -> Column:
    return one_of([(score >= 7, "PASS"), (score >= 4, "MARGINAL")], "FAIL")
