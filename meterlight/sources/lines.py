"""Lines of log files with their numbers, and what all log sources share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.functions.identity import identity_hash
from meterlight.schema import METRICS, ORIGIN_EXACT, ORIGIN_UNAVAILABLE

#: Longest line that is read, in bytes.
LONGEST_LINE = 8 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(entity, path, line, value) of text files: lines are numbered from 1 in each file by
    the place of their split and their order in it, so large files are read in parts.
    Carriage returns at ends of lines go; overlong lines stay out but keep their number."""
    rows = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    counted = rows.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("start", "id")).cast("bigint"))
    return entities(counted.where(F.octet_length("value") <= LONGEST_LINE)).select("entity", "path", "line", F.regexp_replace("value", "\r$", "").alias("value"))


def entities(lines: DataFrame) -> DataFrame:
    return lines.withColumn("entity", identity_hash("entity", F.col("path")))


def discovered(spark: SparkSession, active: str, archived: str | None = None, suffix: str = "*.jsonl") -> DataFrame:
    """(entity, path, name, size, modified) of source files below the folders, by path.
    A name that both have counts once, the active one. A folder that can't be read
    fails the whole listing, so nothing is taken for gone that wasn't seen."""
    found = None
    for rank, folder in enumerate(x for x in (active, archived) if x):
        files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(folder)
        part = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(rank).alias("rank"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("name").agg(F.min_by(F.struct("path", "size", "modified"), F.struct("rank", "path")).alias("x"))
    return entities(first.select("name", "x.*")).select("entity", "path", "name", "size", "modified").orderBy("path")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Entities of snapshot sources whose (name, size, modified) differ from the stamps read last."""
    same = [now[c].eqNullSafe(before[c]) for c in ("entity", "name", "size", "modified")]
    return now.join(before, same[0] & same[1] & same[2] & same[3], "left_anti")


def in_file() -> Window:
    return Window.partitionBy("entity").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(value: Column) -> Column:
    """The last value seen so far in the file."""
    return F.last(value, ignorenulls=True).over(in_file())


def tokens(cache: Column | int = 0, thought: Column | int = 0, origins: dict[str, Column] | None = None, /, **values: Column) -> list[Column]:
    """<metric>_value and <metric>_origin of all metrics, and the inclusion codes;
    metrics that aren't given, or are null, are unavailable."""
    out = []
    for name in METRICS:
        value = values.get(name, F.lit(None)).cast("bigint")
        origin = (origins or {}).get(name, F.lit(ORIGIN_EXACT))
        out += [value.alias(f"{name}_value"), F.when(value.isNull(), ORIGIN_UNAVAILABLE).otherwise(origin).alias(f"{name}_origin")]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [*out, as_column(cache).alias("cache_included"), as_column(thought).alias("reasoning_included")]


def inclusion(known: Column, included: Column | bool) -> Column:
    """Codes: 0 unknown, 1 included, 2 separate."""
    return F.when(~known, 0).when(included if isinstance(included, Column) else F.lit(included), 1).otherwise(2)
