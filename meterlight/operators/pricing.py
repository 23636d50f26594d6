"""Equivalent price of events, from rates per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.schema import INCLUDED, MISSING_CACHED, MISSING_CACHED_RATE, MISSING_LONG, MISSING_OUTPUT, MISSING_RULE, MISSING_UNCACHED, MISSING_WRITE, MISSING_WRITE_RATE, PARTLY_PRICED, PRICED, UNPRICED

#: model, rates in USD per million tokens, threshold and multipliers of long contexts.
RATES = "model string, input_rate decimal(18,9), cached_rate decimal(18,9), write_rate decimal(18,9), output_rate decimal(18,9), long_threshold bigint, long_input decimal(9,6), long_output decimal(9,6)"


def layered(official: DataFrame, upstream: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Official rates, upstream ones for models without, then aliases (alias,
    priced_as) of either for models without."""
    out = official
    if upstream is not None:
        out = out.unionByName(upstream.join(out, "model", "left_anti"))
    if aliases is not None:
        new = aliases.join(out, F.col("alias") == F.col("model"), "left_anti")
        out = out.unionByName(new.join(out, F.col("priced_as") == F.col("model")).drop("model", "priced_as").withColumnRenamed("alias", "model"))
    return out


def effective(built_in: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Overrides before built-in rates, with source 1 and 0."""
    built = built_in.withColumn("rate_source", F.lit(0))
    if overrides is None:
        return built
    keyed = overrides.withColumn("model", F.lower(F.trim("model"))).withColumn("rate_source", F.lit(1))
    return keyed.unionByName(built.join(keyed, "model", "left_anti"))


def _cost(tokens: Column, rate: Column, multiplier: Column) -> Column:
    """Tokens times rate times multiplier over a million, exact to 15 places."""
    each = (rate * multiplier).cast("decimal(18,9)") * F.lit("0.000001").cast("decimal(7,6)")
    return (tokens.cast("decimal(19,0)") * each.cast("decimal(18,15)")).cast("decimal(30,15)")


def estimate(events: DataFrame, rates: DataFrame) -> DataFrame:
    """``events`` with estimated_cost, pricing_status and pricing_missing. Models
    match trimmed and lower-cased; the rates, a catalog of models, may be broadcast
    by Spark where they are small. A model without rates has flag 1 and no cost."""
    priced = events.drop("estimated_cost", "pricing_status", "pricing_missing").join(rates.withColumn("__rule", F.lit(1)), F.lower(F.trim("normalized_model")) == F.col("model"), "left")
    value = lambda m: F.col(f"{m}_value")
    flag = lambda on, bit: F.when(on, bit).otherwise(0)
    one = F.lit(1).cast("decimal(9,6)")
    has_long = F.col("long_threshold").isNotNull()
    is_long = has_long & value("input_reported").isNotNull() & (value("input_reported") > F.col("long_threshold"))
    in_x, out_x = F.when(is_long, F.coalesce("long_input", one)).otherwise(one), F.when(is_long, F.coalesce("long_output", one)).otherwise(one)
    included = (F.col("cache_included") == INCLUDED) & value("input_reported").isNotNull()
    uncached = F.coalesce(value("uncached_input"), F.when(included & value("cache_read").isNotNull(), F.greatest(F.lit(0), value("input_reported") - value("cache_read"))))
    cached = F.coalesce(value("cache_read"), F.when(included & value("uncached_input").isNotNull(), F.greatest(F.lit(0), value("input_reported") - value("uncached_input"))))
    write = F.when(F.col("write_rate").isNotNull(), value("cache_write"))
    missing = (
        flag(has_long & value("input_reported").isNull(), MISSING_LONG)
        .bitwiseOR(flag(uncached.isNull(), MISSING_UNCACHED))
        .bitwiseOR(flag(cached.isNull(), MISSING_CACHED))
        .bitwiseOR(flag((cached != 0) & F.col("cached_rate").isNull(), MISSING_CACHED_RATE))
        .bitwiseOR(flag(F.col("write_rate").isNotNull() & value("cache_write").isNull(), MISSING_WRITE))
        .bitwiseOR(flag(F.col("write_rate").isNull() & (value("cache_write") > 0), MISSING_WRITE_RATE))
        .bitwiseOR(flag(value("output").isNull(), MISSING_OUTPUT))
    )
    zero = F.lit(0).cast("decimal(30,15)")
    known = [F.coalesce(_cost(t, F.col(r), x), zero) for t, r, x in ((uncached, "input_rate", in_x), (cached, "cached_rate", in_x), (write, "write_rate", in_x), (value("output"), "output_rate", out_x))]
    ruled = F.col("__rule").isNotNull()
    amount = F.when(ruled, (known[0] + known[1] + known[2] + known[3]).cast("decimal(38,15)"))
    flags = F.when(ruled, missing).otherwise(MISSING_RULE)
    status = F.when(~ruled, UNPRICED).when(flags == 0, PRICED).otherwise(PARTLY_PRICED)
    return priced.withColumns({"estimated_cost": amount, "pricing_status": status, "pricing_missing": flags}).drop(*rates.columns, "__rule")


def frozen(arrivals: DataFrame, rates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key and price of each event: that of its first arrival with a rule, whatever
    arrives later; unpriced where none has one."""
    every = estimate(arrivals, rates)
    rank = F.struct((F.col("pricing_status") == UNPRICED).alias("late"), *order)
    first = every.groupBy(*key).agg(F.min_by(F.struct("estimated_cost", "pricing_status", "pricing_missing"), rank).alias("p"))
    return first.select(*key, "p.*")


def settings(events: DataFrame, built_in: DataFrame, overrides: DataFrame) -> DataFrame:
    """model, observed events, rates in effect and their source (0 built in, 1 custom, 2 none)."""
    seen = events.select(F.lower(F.trim("normalized_model")).alias("model")).where("model <> ''").groupBy("model").agg(F.count("*").alias("observed"))
    listed = seen.join(overrides.select(F.lower(F.trim("model")).alias("model")).distinct(), "model", "full")
    out = listed.join(effective(built_in, overrides), "model", "left")
    return out.select("model", F.coalesce("observed", F.lit(0)).alias("observed"), "input_rate", "output_rate", F.coalesce("rate_source", F.lit(2)).alias("source"))
