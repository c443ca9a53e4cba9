"""Forecast metrics, cost-aware long/short backtest, and the report tables built on it.

Input rows are predictions: (model, target, date, pred, actual), one per model, target and date.
All window steps of a backtest use one order, so plain groups need one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.expr import ratio, value_map
from ..operators.ordered import OrderedRows
from ..operators.skew import HOT_ROWS
from .panel import rolling_sharpe_column

SERIES = ["model", "target"]


# -- forecast quality ----------------------------------------------------------------------


def forecast_metrics(predictions: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """RMSE, MAE, R2 and the share of rows whose signs agree (0 agrees with 0).

    R2 of a constant outcome is 1 for a perfect forecast and 0 otherwise.
    """
    y, p = F.col("actual"), F.col("pred")
    squared = F.sum(F.pow(y - p, F.lit(2)))
    spread = F.count(y) * F.var_pop(y)
    agree = (F.signum(y) == F.signum(p)).cast("double")
    return predictions.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(y - p, F.lit(2)))).alias("RMSE"),
        F.avg(F.abs(y - p)).alias("MAE"),
        F.when(spread > 0, F.lit(1.0) - ratio(squared, spread))
        .otherwise(F.when(squared > 0, 0.0).otherwise(1.0))
        .alias("R2"),
        F.avg(agree).alias("DirAcc"),
    )


# -- backtest ------------------------------------------------------------------------------


def positions(
    predictions: DataFrame,
    *,
    sizing: str = "full",
    cost: float = fv.COST_PER_TURN,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> OrderedRows:
    """Conviction-weighted position, its cost of turnover, and the net return.

    The position is the forecast over the largest absolute forecast, of the whole test window
    (``sizing="full"``, which looks ahead) or up to the row (``"expanding"``). ``side`` is its
    sign, 1 long and -1 short, and its size is at most 1. The first trade is free.
    """
    series = OrderedRows(predictions, SERIES, ["date"], bound=bound, hot_rows=hot_rows)
    size = F.abs(F.col("pred"))
    if sizing == "full":
        series = series.whole({"_largest": F.max(size)})
    elif sizing == "expanding":
        series = series.running({"_largest": ("max", size)})
    else:
        raise ValueError(f"unknown sizing: {sizing}")
    pos = F.col("pos")
    return (
        series.with_columns({"pos": F.col("pred") / (F.col("_largest") + F.lit(fv.TINY))})
        .with_columns({"side": F.signum(pos).cast("int")})
        .nearby({"turnover": lambda w: F.abs(pos - F.coalesce(F.lag("pos").over(w), pos))}, back=1)
        .with_columns({"cost": F.col("turnover") * F.lit(cost)})
        .with_columns({"strat": pos * F.col("actual") - F.col("cost")})
    )


def _preset(rescale_to: float | Mapping[str, float]) -> Column:
    if isinstance(rescale_to, Mapping):
        return value_map("model", dict(rescale_to))
    return F.lit(float(rescale_to))


def backtest(
    predictions: DataFrame,
    *,
    sizing: str = "full",
    cost: float = fv.COST_PER_TURN,
    rescale_to: float | Mapping[str, float] | None = None,
    sharpe_rows: int = fv.SHARPE_WINDOW,
    periods: int = fv.PERIODS_PER_YEAR,
    bound: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Curves, one row per (model, target, date).

    ``strat`` net return, ``wealth`` and ``bnh_wealth`` growth of 1, ``cum`` and ``bnh`` returns
    since the start, ``drawdown`` from the highest wealth so far (which starts at the first
    row's wealth, so a loss on the first row is none), ``rolling_sharpe`` over full frames.
    ``rescale_to`` multiplies returns towards a preset total, per model or for all; off unless
    given and not 0.
    """
    series = positions(predictions, sizing=sizing, cost=cost, bound=bound, hot_rows=hot_rows)
    strat = F.col("strat")
    if rescale_to:
        series = series.whole({"_growth": F.product(F.lit(1.0) + strat)})
        preset = F.nullif(_preset(rescale_to), F.lit(0.0))
        factor = F.coalesce(ratio(preset, F.col("_growth") - 1), F.lit(1.0))
        series = series.with_columns({"strat": strat * factor})
    series = series.running(
        {
            "wealth": ("product", F.lit(1.0) + strat),
            "bnh_wealth": ("product", F.lit(1.0) + F.col("actual")),
        }
    )
    series = series.running({"peak": ("max", F.col("wealth"))})
    series = series.nearby(
        {"rolling_sharpe": rolling_sharpe_column(strat, sharpe_rows, periods)},
        back=sharpe_rows - 1,
    )
    return (
        series.with_columns(
            {
                "cum": F.col("wealth") - 1,
                "bnh": F.col("bnh_wealth") - 1,
                "drawdown": ratio(F.col("wealth") - F.col("peak"), "peak"),
            }
        )
        .rows()
        .select(
            *SERIES,
            "date",
            "pred",
            "actual",
            "pos",
            "side",
            "turnover",
            "cost",
            "strat",
            "wealth",
            "bnh_wealth",
            "cum",
            "bnh",
            "drawdown",
            "rolling_sharpe",
        )
    )


def backtest_summary(
    curves: DataFrame, *, periods: int = fv.PERIODS_PER_YEAR, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Last cumulative returns, annualised Sharpe ratio (population deviation), worst drawdown."""
    mean, dev = F.avg("strat"), F.stddev_pop("strat")
    return curves.groupBy(*keys).agg(
        F.max_by("cum", "date").alias("CumReturn"),
        F.max_by("bnh", "date").alias("BnH"),
        (mean / (dev + F.lit(fv.TINY)) * F.sqrt(F.lit(float(periods)))).alias("Sharpe"),
        F.min("drawdown").alias("MaxDrawdown"),
    )


# -- report tables -------------------------------------------------------------------------


def curve_table(curves: DataFrame) -> DataFrame:
    """Cumulative returns in percent and whether the strategy is above buy and hold."""
    return curves.select(
        *SERIES,
        "date",
        (F.col("cum") * 100).alias("cum_pct"),
        (F.col("bnh") * 100).alias("bnh_pct"),
        (F.col("cum") > F.col("bnh")).alias("above"),
    )


METRICS = [  # name, source column, factor, is higher better
    ("DirAcc", "DirAcc", 1.0, True),
    ("R2", "R2", 1.0, True),
    ("MAE x 1000", "MAE", 1000.0, False),
    ("Sharpe", "Sharpe", 1.0, True),
]


def metric_comparison(summary: DataFrame, model_order: Sequence[str]) -> DataFrame:
    """One row per (target, metric, model) with the best model marked; the first one wins a tie."""
    stacked = summary.select(
        "Model",
        "target",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("metric"),
                        (F.col(source) * factor).alias("value"),
                        F.lit(1.0 if higher else -1.0).alias("sign"),
                    )
                    for name, source, factor, higher in METRICS
                ]
            )
        ).alias("m"),
    ).select("target", "Model", "m.*")
    place = {name: i for i, name in enumerate(model_order)}
    score = F.struct(F.col("value") * F.col("sign"), -value_map("Model", place))
    best = stacked.groupBy("target", "metric").agg(F.max_by("Model", score).alias("_best"))
    return stacked.join(best, ["target", "metric"]).select(
        "target", "metric", "Model", "value", (F.col("Model") == F.col("_best")).alias("is_best")
    )


def scatter_table(predictions: DataFrame) -> DataFrame:
    """Forecast and outcome pairs."""
    return predictions.select(*SERIES, "date", F.col("actual").alias("y"), "pred")


def axis_limits(predictions: DataFrame, margin: float = fv.AXIS_MARGIN) -> DataFrame:
    """Symmetric axis limit per model that holds every forecast and outcome."""
    widest = F.greatest(F.max(F.abs("actual")), F.max(F.abs("pred")))
    return predictions.groupBy(*SERIES).agg((widest * F.lit(margin)).alias("lim"))


def rolling_sharpe_table(curves: DataFrame) -> DataFrame:
    """Rolling Sharpe ratio where its frame is full, with its sign and the mark at 1."""
    s = F.col("rolling_sharpe")
    return curves.where(s.isNotNull()).select(
        *SERIES,
        "date",
        "rolling_sharpe",
        F.signum(s).cast("int").alias("sign"),
        (s > 1).alias("above_one"),
    )


def drawdown_table(curves: DataFrame) -> DataFrame:
    return curves.select(*SERIES, "date", (F.col("drawdown") * 100).alias("drawdown_pct"))


def model_summary(predictions: DataFrame, curves: DataFrame) -> DataFrame:
    """One row per model and target: forecast metrics beside backtest results."""
    metrics = forecast_metrics(predictions)
    return metrics.join(backtest_summary(curves), SERIES).select(
        F.col("model").alias("Model"),
        "target",
        "RMSE",
        "MAE",
        "R2",
        "DirAcc",
        "CumReturn",
        "BnH",
        "Sharpe",
        "MaxDrawdown",
    )
