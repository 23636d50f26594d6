"""Figures derived from usage: local periods, gap filling, shares, streaks."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.functions.identity import nocase
from meterlight.plans.tables import save
from meterlight.schema import PRICING_COMPLETE, PRICING_PARTIAL, PRICING_UNPRICED

DAYS = {"today": 1, "7d": 7, "30d": 30, "90d": 90}


def period(name: str, zone: str, today: date, first_ms: int | None = None) -> tuple[datetime, datetime]:
    """UTC bounds of the last local calendar days, today included; ``all`` starts on
    the local day of the first event (``first_ms``; without any, today)."""
    tz = ZoneInfo(zone)
    if name == "all":
        first = today if first_ms is None else (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=first_ms)).astimezone(tz).date()
        n = max(1, (today - first).days + 1)
    else:
        n = DAYS[name]
    start, end = today - timedelta(days=n - 1), today + timedelta(days=1)
    return tuple(datetime(d.year, d.month, d.day, tzinfo=tz).astimezone(UTC) for d in (start, end))


def custom_period(start: datetime, end: datetime, zone: str) -> tuple[datetime, datetime]:
    """UTC bounds of local whole hours; times that a clock change skips are refused."""
    tz, out = ZoneInfo(zone), []
    for at in (start, end):
        local = at.replace(tzinfo=tz)
        if at.minute or at.second or at.microsecond:
            raise ValueError("whole hours are asked for")
        if local.astimezone(UTC).astimezone(tz).replace(tzinfo=None) != at:
            raise ValueError(f"{at} does not exist in {zone}")
        out.append(local.astimezone(UTC))
    if out[1] <= out[0]:
        raise ValueError("the end must be after the start")
    return out[0], out[1]


def granularity(start: datetime, end: datetime, free: bool) -> str:
    """hour up to 72 hours; week beyond 90 days of a free range; else day."""
    hours = (end - start) / timedelta(hours=1)
    return "hour" if hours <= 72 else "week" if free and hours > 90 * 24 else "day"


def local_bucket(bucket_ms: Column, unit: str, zone: str) -> Column:
    """The local day or Monday-started week of a UTC hour, as a date, whatever the
    session's own time zone is."""
    utc = F.timestamp_add("SECOND", (bucket_ms / 1000).cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.to_date(F.date_trunc(unit, local.cast("date")) if unit == "week" else local.cast("date"))


def regroup(trend: DataFrame, unit: str, zone: str) -> DataFrame:
    """A trend by hour as local days or weeks; sums of nothing stay null."""
    sums = [F.bit_or(c).alias(c) if c == "missing" else F.sum(c).alias(c) for c in trend.columns if c != "bucket_ms"]
    return trend.groupBy(local_bucket(F.col("bucket_ms"), unit, zone).alias("bucket")).agg(*sums)


def fill(rows: DataFrame, start: date, end: date, step: str, zeros: list[str]) -> DataFrame:
    """Every bucket from start to before end; missing ones have 0 in ``zeros`` and
    null elsewhere. The dates are as many as the range has, not the rows."""
    spark = rows.sparkSession
    last = end - timedelta(days=1)
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(last), F.expr(f"interval 1 {step}"))).alias("bucket"))
    return dates.join(rows, "bucket", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def fill_known(rows: DataFrame, start: date, end: date, step: str, key: str, values: list[str]) -> DataFrame:
    """Every bucket of each key: missing ones are 0 in a value that the key knows in any
    bucket, else null."""
    keys = rows.groupBy(key).agg(*[F.max(F.col(v).isNotNull()).alias(f"__{v}") for v in values])
    # As many dates as the range has, for each key.
    grid = keys.withColumn("bucket", F.explode(F.sequence(F.lit(start), F.lit(end - timedelta(days=1)), F.expr(f"interval 1 {step}"))))
    joined = grid.join(rows, [key, "bucket"], "left")
    return joined.withColumns({v: F.coalesce(v, F.when(F.col(f"__{v}"), F.lit(0))) for v in values}).drop(*[f"__{v}" for v in values])


def merge_pricing(rows: DataFrame, *keys: str) -> DataFrame:
    """Partial price sums (cost, counts by status, missing) as one by key."""
    return rows.groupBy(*keys).agg(F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in ("priced", "partly_priced", "unpriced")], F.bit_or("missing").alias("missing"))


def daily_average(total: Column, start: Column, end: Column, zone: str) -> Column:
    """A total over the local days that a range of milliseconds touches, rounded, halves up."""
    days = F.datediff(local_bucket(end - 1, "day", zone), local_bucket(start, "day", zone)) + 1
    return F.when(days > 0, F.call_function("div", total * 2 + days, days * 2))


def pinned_day(day: date, start: date, end: date) -> date:
    """A chosen local day within [start, end): the nearest one inside."""
    return min(max(day, start), end - timedelta(days=1))


def ordered(projects: DataFrame, by: str) -> DataFrame:
    """Projects with their place (rank, from 1) by recent, tokens (known ones first) or name.
    They are sorted by ranges; a range's places start behind those of the ranges before it."""
    orders = {"recent": [F.desc_nulls_last("last_ms")], "tokens": [F.desc_nulls_last("normalized_total")], "name": []}
    by_range = projects.orderBy(*orders[by], nocase(F.coalesce("path", "project")), "project")
    numbered = save(by_range.withColumns({"__range": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ordered")
    # As many rows as there are ranges.
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", "__low", before.alias("__before"))
    ranked = numbered.join(F.broadcast(starts), "__range").withColumn("rank", (F.col("__id") - F.col("__low") + F.col("__before") + 1).cast("int"))
    return ranked.select(*projects.columns, "rank")


#: What is shown without an amount, and without a price.
NO_AMOUNT, NO_PRICE = "—", "未计价"


def shown_price(amount: Column, coverage: Column) -> Column:
    """An amount of US dollars as text, by its coverage: two places, four below a cent, halves
    away from zero; a mark where there is no amount, and another where nothing has a price."""
    places = lambda n: F.concat(F.lit("$"), F.round(amount, n).cast(f"decimal(38,{n})").cast("string"))
    text = F.when(amount <= 0, "$0.00").when(amount >= F.lit("0.01").cast("decimal(3,2)"), places(2)).otherwise(places(4))
    known = coverage.isin(PRICING_COMPLETE, PRICING_PARTIAL) & amount.isNotNull()
    return F.when(coverage == PRICING_UNPRICED, NO_PRICE).when(known, text).otherwise(NO_AMOUNT)


def heat_level(value: Column) -> Column:
    """0 without tokens, else 1 to 4 by quarters of the largest value; of days of one
    calendar, a year or so of rows."""
    top = F.max(value).over(Window.partitionBy())
    return F.when(F.coalesce(value, F.lit(0)) <= 0, 0).when(value * 4 <= top, 1).when(value * 2 <= top, 2).when(value * 4 <= top * 3, 3).otherwise(4)


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Parts per million of the whole; null if any row's value is unknown."""
    everything = Window.partitionBy()
    whole, known = F.sum(value).over(everything), F.count(value).over(everything) == F.count("*").over(everything)
    return rows.withColumn("__whole", F.when(known & (whole > 0), whole)).withColumn("share", F.expr(f"({value} * 1000000) div __whole")).drop("__whole")


def top(rows: DataFrame, value: str, n: int, *tie: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(value), *tie).limit(n)


def most_active(days: DataFrame, value: str) -> DataFrame:
    """The first of the days with the largest value."""
    return days.where(F.col(value) > 0).orderBy(F.desc(value), "bucket").limit(1).select("bucket", value)


def project_stats(days: DataFrame, key: str, value: str, end: date) -> DataFrame:
    """Active days, the run of active days up to the range's end, and the peak day of
    each key; ``days`` has a row for each key and day (bucket) with events. All are
    null where the tokens of any such day are unknown."""
    whole = days.groupBy(key).agg(F.max(F.col(value).isNull()).alias("unknown"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bucket")))
    ranked = days.where(F.col(value) > 0).withColumn("__rank", rank)
    trailing = F.date_add("bucket", F.col("__rank")) == F.lit(end)
    stats = ranked.groupBy(key).agg(
        F.count("*").alias("active_days"), F.count_if(trailing).alias("streak"),
        F.min_by("bucket", F.struct((-F.col(value)).alias("v"), "bucket")).alias("peak_day"), F.max(value).alias("peak"),
    )
    known = lambda c, zero: F.when(~F.col("unknown"), F.coalesce(c, F.lit(zero)) if zero is not None else F.col(c)).alias(c)
    return whole.join(stats, key, "left").select(key, known("active_days", 0), known("streak", 0), known("peak_day", None), known("peak", None))


def tool_frequency(tools: DataFrame) -> DataFrame:
    return tools.groupBy("agent_id", "source_instance_id", "dedup_key", "tool_name").agg(F.count("*").alias("n"))


def search(projects: DataFrame, text: str) -> DataFrame:
    """Projects whose name or path contains a text, ignoring case."""
    return projects.where(F.lower("project").contains(text.lower()) | F.lower(F.coalesce("path", F.lit(""))).contains(text.lower()))
