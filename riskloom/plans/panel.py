"""Return panels and features.

A panel is long: one row per (symbol, date) with a price or a return. ``densify`` gives every
symbol every date of a calendar, so a group of a panel is never longer than the calendar; that
length is known before any window runs and is handed on as ``bound``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.ordered import OrderedRows
from ..operators.skew import HOT_ROWS

# -- calendar ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Calendar:
    """Equally spaced dates. ``length`` bounds every densified series."""

    start: str
    stop: str
    step: str  # an interval text such as "7 days" or "1 hour"
    length: int
    kind: str = "date"  # or "timestamp_ntz"

    def dates(self) -> Column:
        """All dates as one array."""
        start, stop = F.lit(self.start).cast(self.kind), F.lit(self.stop).cast(self.kind)
        return F.sequence(start, stop, F.expr(f"interval {self.step}"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.explode(self.dates()).alias("date"))


DAY = 86_400_000_000  # microseconds


def _micros(date: Column, zero: Column, kind: str) -> Column:
    """Microseconds from ``zero`` to ``date``, reckoned without a time zone."""
    days = F.date_diff(date.cast("date"), zero.cast("date")).cast("long") * DAY
    if kind == "date":
        return days

    def of_day(t: Column) -> Column:
        whole = ((F.hour(t) * 60 + F.minute(t)) * 60).cast("long") * 1_000_000
        return whole + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")

    return days + of_day(date) - of_day(zero)


def interval_start(date: Column, anchor: Column, step: str, kind: str) -> Column:
    """The last of ``anchor + k * step`` that is not after ``date``; ``step`` has a fixed length.

    Whole-number arithmetic without a time zone, so clock changes of a session zone do not matter.
    """
    if kind not in ("date", "timestamp_ntz"):
        raise TypeError(f"calendars are of date or timestamp_ntz, not {kind}")
    zero = anchor.cast(kind)
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    each = _micros(start + F.expr(f"interval {step}"), start, "timestamp_ntz")  # a constant
    since = _micros(date.cast(kind), zero, kind)
    back = since - F.pmod(since, each)
    if kind == "date":
        return F.date_add(zero, F.floor(back / F.lit(DAY)).cast("int"))
    return zero + F.expr("INTERVAL '0.000001' SECOND") * back


def calendar_of(
    df: DataFrame, date: str = "date", step: str = "7 days", anchor: str | None = None
) -> Calendar:
    """Calendar from the first to the last date of ``df``: one aggregate, three values.

    With an ``anchor`` (any date of the wanted grid, such as a Sunday) it starts at the grid's last
    date that is not after the first one.
    """
    kind = df.schema[date].dataType.simpleString()
    ends = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    if anchor is not None:
        ends = ends.withColumn("lo", interval_start(F.col("lo"), F.lit(anchor), step, kind))
    n = F.size(F.sequence("lo", "hi", F.expr(f"interval {step}")))
    lo, hi, length = ends.select(F.col("lo").cast("string"), F.col("hi").cast("string"), n).first()
    if lo is None:
        raise ValueError("no dates to build a calendar from")
    return Calendar(lo, hi, step, length, kind)


def densify(prices: DataFrame, calendar: Calendar, symbols: DataFrame | None = None) -> DataFrame:
    """Every (symbol, date) of the calendar once; ``price`` is NULL where there was none.

    A price counts for the calendar interval that its date falls in; of several the last one does,
    of several of one date the largest. Prices before the calendar or after its last interval are
    left out.
    """
    names = prices.select("symbol").distinct() if symbols is None else symbols
    empty = F.lit(None).cast(prices.schema["price"].dataType)
    grid = names.withColumn("date", F.explode(calendar.dates())).select(
        "symbol", "date", F.lit(True).alias("_on"), F.col("date").alias("_at"), empty.alias("price")
    )
    start = interval_start(F.col("date"), F.lit(calendar.start), calendar.step, calendar.kind)
    seen = prices.where(F.col("price").isNotNull()).select(
        "symbol", start.alias("date"), F.lit(False).alias("_on"), F.col("date").alias("_at"), "price"
    )
    # one exchange puts the grid and the prices together; only dates of the grid stay
    last = F.max(F.when(F.col("price").isNotNull(), F.struct("_at", "price")))["price"]
    both = grid.unionByName(seen).groupBy("symbol", "date")
    return (
        both.agg(F.max("_on").alias("_on"), last.alias("price"))
        .where("_on")
        .select("symbol", "date", "price")
    )


def log_returns(
    prices: DataFrame,
    *,
    fill: float | None = 0.0,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``ln(price / previous price)`` per symbol; ``fill`` where either is missing or not positive."""

    def log_return(w):
        before = F.lag("price").over(w)
        both = (F.col("price") > 0) & (before > 0)
        return F.when(both, F.ln(F.col("price") / before))

    series = OrderedRows(prices, ["symbol"], ["date"], bound=bound, hot_rows=hot_rows)
    out = series.nearby({"ret": log_return}, back=1).rows()
    ret = F.col("ret") if fill is None else F.coalesce("ret", F.lit(fill))
    return out.select("symbol", "date", ret.alias("ret"))


# -- rolling columns -----------------------------------------------------------------------


def rolling_full(how, value: Column, rows: int):
    """Window column over ``rows`` rows; NULL unless the frame holds that many values."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(value).over(frame) == rows, how(value).over(frame))

    return build


def rolling_sharpe_column(value: Column, rows: int, periods: int):
    """Mean over sample deviation of the frame, annualised; NULL until the frame is full."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        mean, dev = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
        sharpe = mean / (dev + F.lit(fv.TINY)) * F.sqrt(F.lit(float(periods)))
        return F.when(F.count(value).over(frame) == rows, sharpe)

    return build


def lag_columns(value: str, lags: Sequence[int], prefix: str) -> dict:
    """Window columns ``<prefix><k>``: the value ``k`` rows earlier, NULL where there is none."""
    return {
        f"{prefix}{k}": (lambda w, k=k: F.col(value) if k == 0 else F.lag(value, k).over(w))
        for k in lags
    }


def lagged(
    returns: DataFrame,
    lags: Sequence[int],
    *,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Past returns of every series as columns ``lag_<k>``. Nothing wraps around the ends."""
    series = OrderedRows(returns, ["symbol"], ["date"], bound=bound, hot_rows=hot_rows)
    return series.nearby(lag_columns("ret", lags, "lag_"), back=max(lags)).rows()


def own_features(
    returns: DataFrame,
    *,
    horizon: int = 1,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Trend, volatility and momentum of every series, and the return ``horizon`` rows later.

    With ``horizon=0`` the label is the return of the row itself, which the features contain.
    """
    ret = F.col("ret")
    columns = {
        f"ma{fv.MEAN_SHORT}": rolling_full(F.avg, ret, fv.MEAN_SHORT),
        f"ma{fv.MEAN_LONG}": rolling_full(F.avg, ret, fv.MEAN_LONG),
        f"vol{fv.VOLATILITY}": rolling_full(F.stddev_samp, ret, fv.VOLATILITY),
        f"momentum_{fv.MOMENTUM}": rolling_full(F.sum, ret, fv.MOMENTUM),
        "label": lambda w: ret if horizon == 0 else F.lead("ret", horizon).over(w),
    }
    series = OrderedRows(returns, ["symbol"], ["date"], bound=bound, hot_rows=hot_rows)
    back = max(fv.MEAN_SHORT, fv.MEAN_LONG, fv.VOLATILITY, fv.MOMENTUM) - 1
    return series.nearby(columns, back=back, ahead=horizon).rows()


OWN_FEATURES = [
    f"ma{fv.MEAN_SHORT}",
    f"ma{fv.MEAN_LONG}",
    f"vol{fv.VOLATILITY}",
    f"momentum_{fv.MOMENTUM}",
]
CROSS_FEATURES = ["cross_mean", "cross_dispersion"]


# -- cross-section -------------------------------------------------------------------------


def cross_section(returns: DataFrame) -> DataFrame:
    """Mean and sample deviation over the symbols of each date; missing returns do not count."""
    return returns.groupBy("date").agg(
        F.avg("ret").alias("cross_mean"), F.stddev_samp("ret").alias("cross_dispersion")
    )


def supplier_columns(
    suppliers: Sequence[str], lags: Sequence[int] | Mapping[str, int]
) -> dict[str, tuple[str, int]]:
    """Feature name -> (symbol, lag). A mapping gives each supplier its own single lag."""
    if isinstance(lags, Mapping):
        return {f"{s}_ret": (s, lags[s]) for s in suppliers}
    return {f"{s}_ret" if k == 0 else f"{s}_ret_lag{k}": (s, k) for s in suppliers for k in lags}


def supplier_features(
    returns: DataFrame,
    suppliers: Sequence[str],
    lags: Sequence[int] | Mapping[str, int] = (0,),
    *,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per date: a column per supplier and lag, and the cross-section of the suppliers."""
    named = supplier_columns(suppliers, lags)
    used = sorted({k for _, k in named.values()})
    theirs = returns.where(F.col("symbol").isin(list(suppliers)))
    past = lagged(theirs, used, bound=bound, hot_rows=hot_rows)
    # a pivot with known names, written as conditional aggregates: one exchange by date
    wide = [
        F.max(F.when(F.col("symbol") == s, F.col(f"lag_{k}"))).alias(name)
        for name, (s, k) in named.items()
    ]
    return past.groupBy("date").agg(
        *wide, F.avg("ret").alias("cross_mean"), F.stddev_samp("ret").alias("cross_dispersion")
    )


def make_features(
    returns: DataFrame,
    targets: Sequence[str],
    suppliers: Sequence[str],
    *,
    lags: Sequence[int] | Mapping[str, int] = (0,),
    horizon: int = 1,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows (target, date, label, features), complete rows only.

    By default the label is the target's next return and every feature uses returns up to the
    row's date. Supplier columns are built once per date and joined to each target by date.
    """
    own = own_features(
        returns.where(F.col("symbol").isin(list(targets))),
        horizon=horizon,
        bound=bound,
        hot_rows=hot_rows,
    )
    theirs = supplier_features(returns, suppliers, lags, bound=bound, hot_rows=hot_rows)
    names = feature_names(suppliers, lags)
    rows = own.join(theirs, "date").select(
        F.col("symbol").alias("target"), "date", "label", *names
    )
    return rows.na.drop(subset=["label", *names])


def feature_names(
    suppliers: Sequence[str], lags: Sequence[int] | Mapping[str, int] = (0,)
) -> list[str]:
    """Features of ``make_features`` in column order: all its columns but the label and keys."""
    return [*supplier_columns(suppliers, lags), *OWN_FEATURES, *CROSS_FEATURES]


# -- split and scaling ---------------------------------------------------------------------


def chrono_split(
    rows: DataFrame,
    fraction: float = fv.TRAIN_FRACTION,
    *,
    keys: Sequence[str] = ("target",),
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``is_train``: the first ``int(fraction * n)`` dates of every target."""
    done = (
        OrderedRows(rows, keys, ["date"], bound=bound, hot_rows=hot_rows)
        .position("_rn")
        .whole({"_n": F.count(F.lit(1))})
    )
    limit = F.floor(F.lit(fraction) * F.col("_n"))
    return done.with_columns({"is_train": F.col("_rn") <= limit}).rows().drop("_rn", "_n")


def train_statistics(
    rows: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Mean and population deviation of each feature over the training rows, per target."""
    spread = [
        c
        for f in features
        for c in (F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"dev_{f}"))
    ]
    return rows.where("is_train").groupBy(*keys).agg(*spread)


def standardise(
    rows: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Scale features with statistics of the training rows only. A constant feature becomes 0."""
    stats = train_statistics(rows, features, keys=keys)
    scaled = {
        f: (F.col(f) - F.col(f"mean_{f}"))
        / F.when(F.col(f"dev_{f}") > 0, F.col(f"dev_{f}")).otherwise(F.lit(1.0))
        for f in features
    }
    return rows.join(stats, list(keys)).withColumns(scaled).select(*rows.columns)
