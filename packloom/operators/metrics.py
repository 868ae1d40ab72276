"""Roll-up of training-metric rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warmup_rate(step: Column, base: float, warm: int) -> Column:
    """Learning rate that rises for ``warm`` steps and then stays."""
    return F.when(step < warm, F.lit(base) * (step + 1) / warm).otherwise(F.lit(base))


def cosine_rate(step: Column, base: float, low: float, warm: int, last: int) -> Column:
    """Learning rate that rises for ``warm`` steps and falls along a cosine to ``low`` at step ``last``."""
    turned = F.cos(F.lit(math.pi) * (step - warm) / (last - warm))
    fall = F.lit(low) + F.lit((base - low) * 0.5) * (1 + turned)
    return F.when(step < warm, F.lit(base) * (step + 1) / warm).when(step >= last, F.lit(low)).otherwise(fall)


def metrics_rollup(df: DataFrame, interval: int, accum: int, world: int) -> DataFrame:
    """Loss and time per complete interval of steps from ``(rank, micro, loss, seconds)`` rows.

    Losses are averaged over ranks, steps and micro-steps; time is rank 0's alone. An interval that lacks any
    micro-step of any rank is not reported.
    """
    step = F.floor(F.col("micro") / F.lit(accum)) + 1
    grouped = (
        df.withColumn("interval", F.floor((step - 1) / F.lit(interval)))
        .groupBy("interval")
        .agg(
            F.count("*").alias("__rows"),
            F.sum("loss").alias("__loss"),
            F.sum(F.when(F.col("rank") == 0, F.col("seconds"))).alias("__seconds"),
        )
    )
    return grouped.where(F.col("__rows") == world * interval * accum).select(
        ((F.col("interval") + 1) * interval).alias("step"),
        (F.col("__loss") / world / interval / accum).alias("train_loss"),
        (F.col("__seconds") / interval).alias("time_per_step"),
    )
