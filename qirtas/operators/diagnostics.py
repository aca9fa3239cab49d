"""Classification of engine errors and of machine states, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def engine_error(status: Column, message: Column) -> Column:
    """What a local engine's failure means: timeout, missing model, connection or other."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 404, "model_not_loaded")
        .when(status.isNotNull(), "connection")
        .when(text.contains("timeout") | text.contains("timed out"), "timeout")
        .when(text.rlike("connect|refused|unreachable"), "connection")
        .otherwise("other")
    )


def cloud_error(status: Column, message: Column) -> Column:
    """What a cloud engine's failure means, by status first, then by its message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403) | text.rlike("permissiondenied|unauthenticated"), "auth")
        .when((status == 429) | text.contains("resourceexhausted"), "quota")
        .when(text.rlike("deadlineexceeded|timeout|timed out"), "timeout")
        .when((status == 503) | text.rlike("unavailable|connection"), "connection")
        .otherwise("other")
    )


def offload_mode(size: Column, video_memory: Column) -> Column:
    """How much of a loaded model lies in video memory."""
    ratio = F.coalesce(video_memory, F.lit(0)) / size
    part = F.format_string("partial GPU (%.0f%% in VRAM)", ratio * 100)
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "not loaded").when(ratio >= 0.999, "100% GPU").when(ratio <= 0.001, "CPU-only").otherwise(part)


def missing_models(wanted: Column, installed: Column) -> Column:
    """Models that are wanted and not installed; a name without a tag means ':latest'."""
    full = lambda names: F.transform(names, lambda n: F.when(F.instr(n, ":") > 0, n).otherwise(F.concat(n, F.lit(":latest"))))
    return F.array_except(full(wanted), full(installed))


def check_summary(checks: DataFrame) -> DataFrame:
    """One row of checks (``name, ok``): how many, how many failed, whether all are fine."""
    return checks.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed")).withColumn("all_ok", F.col("n_failed") == 0)
