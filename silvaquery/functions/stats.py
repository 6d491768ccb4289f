"""Robust and regression statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def robust(df: DataFrame, *columns: str) -> DataFrame:
    """One row: ``<c>_med`` and ``<c>_sig`` (1.4826 * MAD) of each column, nulls left out, percentiles by linear interpolation."""
    med = df.agg(*(F.percentile(c, F.lit(0.5)).alias(f"{c}_med") for c in columns))
    both = df.select(*columns).crossJoin(F.broadcast(med))  # one row: a set of plot-level scalars
    return both.agg(*(x for c in columns for x in (
        F.first(f"{c}_med").alias(f"{c}_med"), (F.percentile(F.abs(F.col(c) - F.col(f"{c}_med")), F.lit(0.5)) * 1.4826).alias(f"{c}_sig"))))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, b0, b1)`` of y = b0 + b1 x; b0 and b1 null without spread in x."""
    return df.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.regr_intercept(y, x).alias("b0"), F.regr_slope(y, x).alias("b1"))


def both_positive(x: Column, y: Column) -> Column:
    return F.coalesce((x > 0) & (y > 0), F.lit(False))


def validation(df: DataFrame, reference: str, measured: str) -> DataFrame:
    """One row of accuracy statistics over pairs both above zero; the others are counted as unusable. Below two pairs all but counts is null."""
    ok = both_positive(F.col(reference), F.col(measured))
    x, y = F.when(ok, F.col(reference)), F.when(ok, F.col(measured))
    d = y - x
    n = F.count(x)
    enough = n >= 2
    return df.agg(
        n.alias("n"), (F.count("*") - n).alias("n_unusable"), F.when(enough, F.avg(d)).alias("bias"), F.when(enough, F.sqrt(F.avg(d * d))).alias("rmse"),
        F.when(enough, F.regr_r2(y, x)).alias("r2"), F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"),
        F.when(enough, F.min(x)).alias("x_min"), F.when(enough, F.max(x)).alias("x_max"), F.when(enough, F.min(y)).alias("y_min"), F.when(enough, F.max(y)).alias("y_max"))
