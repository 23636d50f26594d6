"""Column expressions that the usage queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.schema import METRICS, ORIGIN_UNAVAILABLE, ORIGIN_UNKNOWN, PARTLY_PRICED, PRICED, UNKNOWN_MODEL, UNPRICED


def metric(name: str) -> list[Column]:
    """Sum, and counts of available, unavailable and unknown values."""
    value, origin = F.col(f"{name}_value"), F.col(f"{name}_origin")
    return [
        F.sum(value).alias(name),
        F.count(value).alias(f"{name}_available"),
        F.count_if(value.isNull() & (origin == ORIGIN_UNAVAILABLE)).alias(f"{name}_unavailable"),
        F.count_if(value.isNull() & (origin == ORIGIN_UNKNOWN)).alias(f"{name}_unknown"),
    ]


def metrics(names: tuple[str, ...] = METRICS) -> list[Column]:
    return [c for name in names for c in metric(name)]


def pricing() -> list[Column]:
    """Known amount, counts by pricing status, and the missing flags of all rows."""
    status = F.col("pricing_status")
    return [
        F.sum(F.when(status.isin(PRICED, PARTLY_PRICED), F.col("estimated_cost"))).alias("cost"),
        *[F.count_if(status == code).alias(name) for name, code in (("priced", PRICED), ("partly_priced", PARTLY_PRICED), ("unpriced", UNPRICED))],
        F.coalesce(F.bit_or("pricing_missing"), F.lit(0)).alias("missing"),
    ]


def span() -> list[Column]:
    return [F.min("occurred_ms").alias("first_ms"), F.max("occurred_ms").alias("last_ms")]


def usage() -> list[Column]:
    return [F.count("*").alias("requests"), *metrics(), *pricing()]


def coverage(name: str) -> Column:
    """Code of how complete a summed metric is."""
    available, unavailable, unknown = (F.col(f"{name}_{x}") for x in ("available", "unavailable", "unknown"))
    return F.when(available > 0, F.when(unavailable + unknown > 0, 2).otherwise(1)).when(unknown > 0, 3).when(unavailable > 0, 4).otherwise(0)


def pricing_coverage() -> Column:
    count = F.col("priced") + F.col("partly_priced") + F.col("unpriced")
    return F.when(count == 0, 0).when(F.col("unpriced") == count, 3).when(F.col("partly_priced") + F.col("unpriced") > 0, 2).otherwise(1)


def model() -> Column:
    return F.coalesce("normalized_model", F.lit(UNKNOWN_MODEL))


def preferred_path() -> Column:
    """The greatest path outside work trees, else the greatest."""
    inside = F.lower(F.replace("project_path", F.lit("/"), F.lit("\\"))).contains("\\.codex\\worktrees\\")
    return F.coalesce(F.max(F.when(~inside, F.col("project_path"))), F.max("project_path"))


def hour_bucket(ms: str = "occurred_ms") -> Column:
    return F.expr(f"({ms} div 3600000) * 3600000")


def cache_hit() -> Column:
    """Cache reads in parts per million of input; null unless known for every request."""
    whole = (F.col("cache_read_available") == F.col("requests")) & (F.col("uncached_input_available") == F.col("requests"))
    total = F.col("cache_read") + F.col("uncached_input")
    return F.when(whole & (total > 0), F.expr("(cache_read * 1000000) div (cache_read + uncached_input)"))
