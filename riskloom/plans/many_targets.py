"""Elastic nets of very many targets from one pass over the rows.

A linear fit needs no rows, only their second moments. ``moments`` adds up the products of features and
label per target in the JVM, with map-side partial sums, so a target with a third of all rows moves as
little as a small one. What reaches the solver is one row per target with k x k numbers; it descends by
coordinates, all targets of a batch at once. Forecasts multiply columns with the target's coefficients,
again without Python.

Features should be standardised (``panel.standardise``): moments of columns whose mean is large beside
their deviation lose digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.skew import key_match, small_enough


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def moments(
    rows: DataFrame, features: Sequence[str], *, label: str = "label", keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Per target: ``n``, ``means`` and ``products`` of [features, label] (sums of products over n).

    Rows with a missing feature or label do not count. Each row becomes one row per feature whose
    products with all others are summed, so an aggregate holds k sums and stays in generated code.
    """
    columns = [*features, label]
    whole = rows.na.drop(subset=columns)
    one = whole.select(*keys, _vector(columns).alias("_z")).select(
        *keys, "_z", F.posexplode("_z").alias("_i", "_x")
    )
    sums = [F.sum(F.col("_x") * F.col("_z")[j]).alias(f"_s{j}") for j in range(len(columns))]
    per_feature = one.groupBy(*keys, "_i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("_sum"), *sums
    )
    line = F.struct("_i", "_sum", F.array(*[f"_s{j}" for j in range(len(columns))]).alias("_line"))
    lines = F.array_sort(F.collect_list(line))  # one entry per feature
    return (
        per_feature.groupBy(*keys)
        .agg(F.max("n").alias("n"), lines.alias("_l"))
        .select(
            *keys,
            "n",
            F.transform("_l", lambda r: r["_sum"] / F.col("n")).alias("means"),
            F.transform("_l", lambda r: F.transform(r["_line"], lambda s: s / F.col("n"))).alias("products"),
        )
    )


def descend(
    gram: np.ndarray, pull: np.ndarray, l1: float, l2: float, max_iter: int, tol: float
) -> np.ndarray:
    """Minimise b'Gb/2 - c'b + l1 |b| + l2 b'b/2 for each of a stack of (G, c); a column at a time."""
    b = np.zeros_like(pull)
    diagonal = np.einsum("tjj->tj", gram)
    scale = np.where(diagonal + l2 > 0, diagonal + l2, 1.0)
    active = np.arange(len(b))
    for _ in range(max_iter):
        g, c, d, s, old = gram[active], pull[active], diagonal[active], scale[active], b[active]
        new = old.copy()
        for j in range(b.shape[1]):
            slope = c[:, j] - np.einsum("tk,tk->t", g[:, j], new) + d[:, j] * new[:, j]
            new[:, j] = np.sign(slope) * np.maximum(np.abs(slope) - l1, 0) / s[:, j]
        b[active] = new
        active = active[np.abs(new - old).max(1) >= tol]
        if not len(active):
            break
    return b


def fit_many_targets(
    rows: DataFrame,
    features: Sequence[str],
    *,
    label: str = "label",
    keys: Sequence[str] = ("target",),
    alpha: float = fv.ELASTIC_NET["alpha"],
    l1_ratio: float = fv.ELASTIC_NET["l1_ratio"],
    max_iter: int = fv.ELASTIC_NET["max_iter"],
    tol: float = 1e-12,
) -> DataFrame:
    """(keys, n, intercept, coefs): the elastic net of every target, with the loss of ``models.elastic_net``.

    ``rows`` are the training rows of all targets. A target with constant labels or features gets
    coefficients of 0; a target without complete rows gets no row.
    """
    features, keys = list(features), list(keys)
    sums = moments(rows, features, label=label, keys=keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema)
    l1, l2, k = alpha * l1_ratio, alpha * (1 - l1_ratio), len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            mean = np.stack(batch["means"].to_numpy())
            product = np.array([np.stack(p) for p in batch["products"]])
            centred = product - mean[:, :, None] * mean[:, None, :]
            b = descend(centred[:, :k, :k], centred[:, :k, k], l1, l2, max_iter, tol)
            out = batch[[*keys, "n"]].copy()
            out["intercept"] = mean[:, k] - (mean[:, :k] * b).sum(1)
            out["coefs"] = list(b)
            yield out

    return sums.mapInPandas(solve, f"{schema}, n long, intercept double, coefs array<double>")


def coefficient_rows(fits: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("target",)) -> DataFrame:
    """(keys, feature, coef) of every target."""
    names = F.array(*[F.lit(f) for f in features])
    return fits.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), "coefs")).alias("c")).select(
        *keys, F.col("c.feature").alias("feature"), F.col("c.coefs").alias("coef")
    )


def predict_many(
    rows: DataFrame, fits: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """``rows`` with ``pred``, the forecast of their target's fit; rows of other targets are left out.

    The fits are broadcast if their counted number is small, else joined as usual.
    """
    names = {k: f"_fit_{k}" for k in keys}
    fits = fits.withColumnsRenamed(names)
    joined = rows.join(small_enough(fits, fits.count()), key_match(rows, fits, names))
    terms = F.zip_with(_vector(features), F.col("coefs"), lambda x, b: x * b)
    pred = F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    return joined.withColumn("_pred", pred).select(*[rows[c] for c in rows.columns], F.col("_pred").alias("pred"))
