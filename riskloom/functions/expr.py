"""Column helpers shared by every report. All of them stay in JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tier(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first rule that is true. A rule that is NULL counts as not true."""
    if not rules:
        return F.lit(default)
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for rule, label in rules[1:]:
        out = out.when(rule, F.lit(label))
    return out.otherwise(F.lit(default))


def band(
    value: ColumnOrName,
    cuts: Sequence[tuple[float, str]],
    default: str,
    *,
    inclusive: bool = False,
    null_label: str | None = None,
) -> Column:
    """Label by ascending upper cut points; NULL gets ``default`` unless ``null_label`` is given."""
    v = as_col(value)
    rules = [((v <= F.lit(cut)) if inclusive else (v < F.lit(cut)), label) for cut, label in cuts]
    if null_label is not None:
        rules = [(v.isNull(), null_label), *rules]
    return tier(rules, default)


def closed_band(
    value: ColumnOrName,
    bands: Sequence[tuple[int | None, int, str]],
    default: str,
    *,
    null_label: str | None = None,
) -> Column:
    """Label by whole-number ranges, both ends included.

    A first range without a lower end holds everything below its upper end plus one.
    A fractional value between two ranges belongs to neither and gets ``default``.
    """
    v = as_col(value)
    rules = [
        ((v < F.lit(hi + 1)) if lo is None else v.between(lo, hi), label) for lo, hi, label in bands
    ]
    if null_label is not None:
        rules = [(v.isNull(), null_label), *rules]
    return tier(rules, default)


def scaled(value: ColumnOrName, unit: float = 1.0, digits: int = 2) -> Column:
    """``value`` in the given unit, rounded half away from zero."""
    return F.round(as_col(value) / F.lit(float(unit)), digits)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Fractional division that gives NULL for a zero or NULL denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def pct(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """``num * 100 / den`` for counts, rounded."""
    return F.round(ratio(as_col(num).cast("double") * F.lit(100.0), den), digits)


def value_pct(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """``num / den * 100`` for amounts, rounded."""
    return F.round(ratio(num, den) * F.lit(100.0), digits)


def flag(rule: Column) -> Column:
    """1 where the rule is true, 0 otherwise, also for NULL."""
    return F.when(rule, F.lit(1)).otherwise(F.lit(0))


def count_if(rule: Column) -> Column:
    """Number of rows where the rule is true (aggregate)."""
    return F.sum(flag(rule))


def sum_if(rule: Column, value: ColumnOrName) -> Column:
    """Sum of ``value`` over rows where the rule is true, 0 elsewhere (aggregate)."""
    return F.sum(F.when(rule, as_col(value)).otherwise(F.lit(0.0)))


def rate_pct(rule: Column, digits: int = 2) -> Column:
    """Share of rows, in percent, where the rule is true (aggregate)."""
    return pct(count_if(rule), F.count(F.lit(1)), digits)


def value_rate_pct(rule: Column, value: ColumnOrName, digits: int = 2) -> Column:
    """Share of ``value``, in percent, on rows where the rule is true (aggregate)."""
    return value_pct(sum_if(rule, value), F.sum(as_col(value)), digits)


def mean_of_sums(total: ColumnOrName, n: ColumnOrName) -> Column:
    """Mean from partial sums and partial non-NULL counts (aggregate)."""
    return ratio(F.sum(as_col(total)), F.sum(as_col(n)))


def weighted_mean(value: ColumnOrName, weight: ColumnOrName) -> Column:
    """Mean of ``value`` where each row stands for ``weight`` rows; NULL values do not count."""
    v, w = as_col(value), as_col(weight)
    return ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def value_map(value: ColumnOrName, mapping: dict) -> Column:
    """Value lookup; a value that is not listed gives NULL."""
    v = as_col(value)
    out = None
    for key, target in mapping.items():
        hit = v == F.lit(key)
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out


def order_rank(value: ColumnOrName, ordered: Sequence[str]) -> Column:
    """Position of the value in a fixed business order, NULL when it is not in the list."""
    return value_map(value, {name: i for i, name in enumerate(ordered, start=1)})


def month_start(date: ColumnOrName) -> Column:
    """First day of the month: group by it and format the few group keys afterwards."""
    return F.trunc(as_col(date), "month")


def month_of(date: ColumnOrName) -> Column:
    return F.date_format(as_col(date), "yyyy-MM")


def clean_label(name: ColumnOrName, suffix: str = "_ret") -> Column:
    """Feature name made readable: drop the suffix text, underscores become blanks."""
    return F.replace(F.replace(as_col(name), F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" "))
