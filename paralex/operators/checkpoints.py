"""Choosing among evaluations of a training run.  A run has few of them, so the
unpartitioned windows here see a table of one row an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_checkpoint(metrics: DataFrame, step: str = "step", metric: str = "metric") -> DataFrame:
    """``step, metric`` of the best evaluation; the earliest of equals."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(step)).alias("s"))).alias("best")
    return metrics.agg(best).select((-F.col("best.s")).alias("step"), F.col("best.m").alias("metric"))


def early_stop(metrics: DataFrame, patience: int | None, step: str = "step", metric: str = "metric") -> DataFrame:
    """``step, waited`` where training would stop: the first evaluation that is the
    ``patience``-th in a row without improvement.  None or 0 never stops."""
    if not patience:
        return metrics.select(F.col(step).alias("step"), F.lit(0).cast("long").alias("waited")).filter(F.lit(False))
    order = Window.orderBy(step)
    before = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = metrics.withColumn("_better", F.coalesce((F.col(metric) > before).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_better").over(order))
    waited = (F.row_number().over(Window.partitionBy("_run").orderBy(step)) - 1).cast("long")
    stops = runs.select(F.col(step).alias("step"), waited.alias("waited")).filter(F.col("waited") >= patience)
    return stops.orderBy("step").limit(1)
