"""Numeric parsing, rounding and order-preserving bucketing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text accepted as a number. Spark's own cast also takes '1d' and '1f', which are corrupt here.
NUMBER_PATTERN = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(text: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes NULL instead of an error."""
    text = _col(text)
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines.

    The last bits of a sum depend on its order, so a value that ends exactly in a 5 could go either
    way; a shift far below the last digit settles it. A negative zero becomes zero.
    """
    return F.round(_col(value) + F.lit(1e-9), digits) + F.lit(0.0)


def magnitude_bucket(value: Column | str, bits: int = 5) -> Column:
    """The lower edge of the value's bucket: the value cut to ``bits + 1`` significant bits.

    The edge never decreases when the value grows, and it needs no knowledge of the data: each
    power of two is split into ``2 ** bits`` buckets. It is what lets ordered work inside one
    large group be spread over many tasks.
    """
    value = _col(value).cast("double")
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # log2 may be off by one in the last place; powers of two are exact, so put it right.
    exponent = (
        F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1)
        .otherwise(guess)
    )
    # Numbers next to zero share one bucket, or their step would round to zero.
    step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-1000)) - bits)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / step) * step)


def share(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 when there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def equal_width_bin(value: Column | str, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1 on [low, high]; the top edge belongs to the last bin."""
    value = _col(value)
    position = F.floor((value - low) / (high - low) * bins)
    bounded = F.least(F.greatest(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(high == low, F.lit(0)).otherwise(bounded)


def all_known(columns) -> Column:
    """No listed column is NULL.

    Stated before a table is used twice: a join adds this test to one of the two uses only, and
    then Spark cannot see that both can share one shuffle.
    """
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
