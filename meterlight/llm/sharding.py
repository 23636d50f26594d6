"""Sharding by a k-d tree over document metadata.

All nodes of a level are split together: one small aggregation gives the extent
of every dimension in every node, the widest is split at the weighted median (for
an odd number of shards, at the matching weighted quantile), which a few
aggregations of 1,024 bins a node close in on. Only sums by node and bin leave
the executors; their number depends on the number of shards, not of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterlight.llm import scratch

BINS = 1024
#: Bits of a dimension's value, and of the hash that parts rows of equal value.
VALUE_BITS, TIE_BITS = 30, 31
#: A cut is final once it is within this part of a shard's weight.
PRECISION = 5e-4
#: Rows of one slot bucket, numbered by one task.
SLOT_ROWS = 50_000


def weight(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _codes(dims: list[Column], kinds: list[T.DataType]) -> list[Column]:
    """Each dimension as a double; strings by hash, so that equal ones stay together."""
    out = []
    for dim, kind in zip(dims, kinds):
        numeric = isinstance(kind, (T.NumericType, T.BooleanType)) or isinstance(kind, (T.DateType, T.TimestampType))
        out.append(dim.cast("timestamp").cast("double") if isinstance(kind, T.DateType) else dim.cast("double") if numeric else F.crc32(dim.cast("string").cast("binary")).cast("double"))
    return out


def assign(
    docs: DataFrame,
    shards: int | None = None,
    *,
    target_bytes: int = 1 << 30,
    dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, size (UTF-8 bytes and 8), text_crc32, shard (0 to shards - 1) and slot
    (gapless from 0 in each shard) of each row; the bytes of the shards are near equal.
    Without a number of shards the tree is split until leaves have ``target_bytes``
    or less.

    Rows of equal value in a dimension, hot groups of them too, are parted by a
    hash of id and text where the cut needs it; only rows equal in both stay
    together. Null and not-a-number values are the least of a dimension; a null
    text has size 8 and the checksum of an empty one. Rows that repeat each get
    a slot. An empty table gives no rows.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    dims = tuple(d for d in dims if d in kinds)
    text = F.coalesce(F.col(text_col), F.lit(""))
    coded = _codes([F.col(d) for d in dims], [kinds[d] for d in dims])
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        weight(F.col(text_col)).alias("size"),
        crc.alias("crc"),
        F.xxhash64(F.col(id_col), crc, F.octet_length(text)).bitwiseAND(F.lit((1 << TIE_BITS) - 1)).alias("tie"),
        *[F.when(~F.isnan(c), c).alias(f"d{i}") for i, c in enumerate(coded)],
    )
    rows = scratch.save(rows, "metadata")
    extent = rows.agg(F.sum("size"), F.count("*"), *[f(f"d{i}") for i in range(len(dims)) for f in (F.min, F.max)]).head()
    total, count = extent[0] or 0, extent[1]
    shards = max(1, -(-total // target_bytes)) if shards is None else shards
    top = (1 << VALUE_BITS) - 1
    keys = []
    for i in range(len(dims)):
        low, high = extent[2 + 2 * i] or 0.0, extent[3 + 2 * i] or 0.0
        scaled = (F.col(f"d{i}") - F.lit(low)) / F.lit((high - low) or 1.0) * (top - 1)
        keys.append(F.shiftleft(F.coalesce(F.floor(scaled).cast("long") + 1, F.lit(0)).cast("long"), TIE_BITS) + F.col("tie"))
    rows = rows.select("id", "size", "crc", "tie", *[k.alias(f"k{i}") for i, k in enumerate(keys)])

    #: Leaves and inner nodes: node -> (first shard, shards); cuts: node -> (dimension, key, left, right).
    nodes, cuts = {0: (0, shards)}, {}
    while growing := {n: s for n, s in nodes.items() if s[1] > 1 and n not in cuts}:
        placed = rows.withColumn("node", _node(cuts)).where(F.col("node").isin(*growing))
        spread = placed.groupBy("node").agg(F.sum("size"), *[f(f"k{i}") for i in range(len(dims)) for f in (F.min, F.max)]).collect()
        goals = {}
        for r in spread:
            wide = max(range(len(dims)), key=lambda i: (r[3 + 2 * i] - r[2 + 2 * i], -i))
            n, part = r[0], growing[r[0]][1]
            goals[n] = [wide, r[2 + 2 * wide], r[3 + 2 * wide] + 1, 0, r[1] * (part // 2) / part]
        found = _quantiles(placed, goals, PRECISION * total / shards)
        for n, (first, part) in growing.items():
            left, right = 2 * n + 1, 2 * n + 2
            cuts[n] = (*found.get(n, (0, 0)), left, right)
            nodes[left], nodes[right] = (first, part // 2), (first + part // 2, part - part // 2)
    shard_of = {n: s[0] for n, s in nodes.items() if n not in cuts}
    placed = rows.select("id", "size", "crc", "tie", _node(cuts, shard_of).alias("shard"))

    buckets = max(1, -(-count // (SLOT_ROWS * shards)))
    while buckets < 16 and buckets * shards < count // 500:
        buckets *= 2
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("tie", "crc"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("tie", "crc", "id")
    numbered = placed.withColumn("own", F.row_number().over(own) - 1).join(first, ["shard", "bucket"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("own")).cast("long").alias("slot"))


def _node(cuts: dict[int, tuple[int, int, int, int]], names: dict[int, int] | None = None) -> Column:
    """The node that a row falls into, as nested conditions over the cuts."""

    def below(n: int) -> Column:
        if n not in cuts:
            return F.lit(names[n] if names else n)
        dim, key, left, right = cuts[n]
        return F.when(F.col(f"k{dim}") < F.lit(key).cast("long"), below(left)).otherwise(below(right))

    return below(0)


def _quantiles(placed: DataFrame, goals: dict[int, list], near: float) -> dict[int, tuple[int, int]]:
    """node -> (dimension, key): the weight under the key is the goal's.
    goals: node -> [dimension, low, high, weight under low, goal]."""
    done: dict[int, tuple[int, int]] = {}
    while goals:
        bin_of, width = F.lit(None).cast("long"), {}
        for n, (dim, low, high, _, _) in goals.items():
            width[n] = max(1, -(-(high - low) // BINS))
            k = F.col(f"k{dim}")
            inside = (F.col("node") == n) & (k >= F.lit(low).cast("long")) & (k < F.lit(high).cast("long"))
            bin_of = F.when(inside, F.floor((k - F.lit(low).cast("long")) / F.lit(width[n])).cast("long") if width[n] < 1 << 20 else F.expr(f"(k{dim} - {low}L) div {width[n]}L")).otherwise(bin_of)
        sums: dict[int, dict[int, int]] = {}
        for r in placed.withColumn("bin", bin_of).where("bin is not null").groupBy("node", "bin").agg(F.sum("size")).collect():
            sums.setdefault(r[0], {})[r[1]] = r[2]
        for n in list(goals):
            dim, low, high, under, goal = goals[n]
            for b in sorted(sums.get(n, {})):
                if under + sums[n][b] > goal:
                    break
                under += sums[n][b]
            else:
                done[n] = (dim, high)
                del goals[n]
                continue
            low, held = low + b * width[n], sums[n][b]
            high = min(high, low + width[n])
            if goal - under <= near or under + held - goal <= near or high - low <= 1:
                done[n] = (dim, low if goal - under <= under + held - goal else high)
                del goals[n]
            else:
                goals[n] = [dim, low, high, under, goal]
    return done
