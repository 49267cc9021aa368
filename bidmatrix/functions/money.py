"""Money as whole cents: sums stay exact and rounding does not depend on summation order."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Text, decimal or double amount as cents, half up; null when NaN or unreadable."""
    exact = amount.try_cast("decimal(38,20)")  # finer than any amount, so the rounding below is the only one
    return (F.round(exact, 2) * 100).cast("bigint")


def div(a: Column, b: Column) -> Column:
    """Whole-number division that truncates toward zero; null when the divisor is zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def half_up(total: Column, n: Column) -> Column:
    """total / n rounded half away from zero, for bigint total and positive n."""
    size = div(F.abs(total) * 2 + n, n * 2)
    return F.when(total < 0, -size).otherwise(size)


def mean_cents(total: Column, n: Column) -> Column:
    """Mean of n values that sum to total, 0 when there are none."""
    return F.coalesce(half_up(total, n), F.lit(0).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    """part as a percentage of whole (double); null when whole is zero."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def amount(cents: Column) -> Column:
    """Cents as a two-decimal amount."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")  # exact, and quicker than a division
