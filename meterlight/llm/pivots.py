"""Hard negatives by inner product, found with a pivot table.

Rows are augmented by one component, sqrt(M - |x|^2) with M the largest squared norm,
and anchors by a zero; then |q - x|^2 = |q|^2 + M - 2 q.x, so inner products order rows as
Euclidean distances do. Each row and each anchor store their distances to a few pivots. By the
triangle inequality these bracket the distance of any two of them, and so their score;
pairs whose bracket can't matter are left out, all others are scored exactly.

Anchors are the stated query set. They are packed into blocks and rows into chunks, and
every chunk meets every block; blocks are broadcast a bounded number of bytes at a
time. A task keeps the best few of each anchor, and the tasks' best are merged by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm import scratch
from meterlight.llm.vectors import matrix, quantised

#: Rows of a chunk or block at most, and about how many bytes; bytes of blocks broadcast at once.
PACK_ROWS, PACK_BYTES, BROADCAST_BYTES = 1024, 4 << 20, 32 << 20
#: Pivots, and how many rows they are chosen from. They decide how much is left out, never what is found.
PIVOTS, SAMPLE = 16, 1024
#: Integer inner products below this are exact as doubles.
EXACT = 2.0**53

PACKED = "block int, pack long, size int, rows binary, ids binary, labels binary, vectors binary, distances binary"


def choose(sample: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, their augmenting components): rows of the sample, each the farthest from
    those before."""
    extra = augmenting(sample, most)
    picked, far = [], np.full(len(sample), np.inf)
    for _ in range(min(PIVOTS, len(sample))):
        picked.append(int(far.argmax()) if picked else 0)
        far = np.minimum(far, distances(sample, extra, sample[picked[-1:]], extra[picked[-1:]])[:, 0])
    return sample[picked], extra[picked]


def augmenting(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Of each row to each pivot, one pivot at a time."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots.astype(float)):
        gap = x - p
        out[:, k] = np.sqrt((gap * gap).sum(axis=1) + (extra - pivot_extra[k]) ** 2)
    return out


def packed(rows: DataFrame, width: int, pivots: np.ndarray, pivot_extra: np.ndarray, most: float | None) -> DataFrame:
    """Rows (block, at, id, label, __q) packed into matrices; without ``most`` they are anchors,
    whose augmenting component is zero."""
    limit = max(1, min(PACK_ROWS, PACK_BYTES // (8 * (width + len(pivots) + 3))))

    def run(batches):
        number = 0
        for batch in batches:
            for low in range(0, batch.num_rows, limit):
                part = batch.slice(low, limit)
                x = matrix(part.column("__q"), width)
                extra = np.zeros(len(x)) if most is None else augmenting(x, most)
                block = part.column("block")[0].as_py()
                whole = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                found = distances(x, extra, pivots, pivot_extra)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((block, pa.int32()), ((block << 32) + number, pa.int64()), (len(x), pa.int32()), *((whole(c), pa.binary()) for c in ("at", "id", "label")), (x.tobytes(), pa.binary()), (found.tobytes(), pa.binary()))],
                    names=["block", "pack", "size", "rows", "ids", "labels", "vectors", "distances"],
                )
                number += 1

    return rows.mapInArrow(run, PACKED)


class Pack:
    """A block or chunk inside a task."""

    def __init__(self, batch: pa.RecordBatch, k: int, width: int, prefix: str = "") -> None:
        get = lambda c, kind="<i8": np.frombuffer(batch.column(prefix + c)[k].as_py(), kind)
        self.rows, self.ids, self.labels = get("rows"), get("ids"), get("labels")
        self.whole = get("vectors").reshape(len(self.ids), width)
        self.x = self.whole.astype(float)
        self.distances = get("distances", "<f8").reshape(len(self.ids), -1)
        self.squares = (self.x * self.x).sum(axis=1)


def brackets(anchors: Pack, chunk: Pack, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each anchor and row of the chunk can have."""
    shape = len(anchors.ids), len(chunk.ids)
    near, far = np.zeros(shape), np.full(shape, np.inf)
    for k in range(anchors.distances.shape[1]):
        a, b = anchors.distances[:, k, None], chunk.distances[None, :, k]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, a + b, out=far)
    total = anchors.squares[:, None] + most
    slack = 1e-9 * total + 1  # far above what rounding can move
    return (total - far * far) / 2 - slack, (total - near * near) / 2 + slack


def scores(anchors: Pack, chunk: Pack, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (a, b)."""
    exact = anchors.squares.max(initial=0) ** 0.5 * chunk.squares.max(initial=0) ** 0.5 < EXACT / 2
    x, y = (anchors.x, chunk.x) if exact else (anchors.whole, chunk.whole)
    if exact and 8 * len(a) > len(anchors.ids) * len(chunk.ids):
        return (x @ y.T)[a, b].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for low in range(0, len(a), 1 << 14):
        out[low : low + (1 << 14)] = (x[a[low : low + (1 << 14)]] * y[b[low : low + (1 << 14)]]).sum(axis=1)
    return out


class Best:
    """The first ``n`` of each of some lists, by descending score, then id."""

    def __init__(self, n: int, lists: int) -> None:
        self.n, self.of, self.score, self.id = n, *(np.zeros(0, np.int64) for _ in range(3))
        #: A score below this can't enter the list any more.
        self.least = np.full(lists, -np.inf)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        last = rank == self.n - 1
        self.least[of[last]] = score[last]
        self.of, self.score, self.id = (v[rank < self.n] for v in (of, score, ids))


def met(chunks: DataFrame, blocks: DataFrame, low: int, high: int) -> DataFrame:
    """Each chunk with each block numbered from low to high, which are broadcast: they have
    ``BROADCAST_BYTES`` at most, or are one block."""
    some = blocks.where(F.col("block").between(low, high))
    named = some.select("block", *[F.col(c).alias(f"a_{c}") for c in some.columns if c != "block"])
    return chunks.drop("block", "pack", "size").withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(F.broadcast(named), "block")


def mine(
    rows: DataFrame, anchors: str = "vec_id % 100 = 0", *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows that fulfil ``anchors``, SQL over the columns of ``rows``. A
    score is the inner product of two rows' components floor(scale * x); higher scores come
    first, ties by id. An anchor's positives are the first other rows of its label; for each
    of them the first rows of other labels come out whose score is at least ``low`` and at
    most ``high`` hundredths of the positive's. Ids and labels are integers.

    Rows with a null id or label, a null vector, or a null, non-finite or (for 64-bit scores)
    too large component take no part. Shorter vectors are filled up with zeros. Each of
    repeated rows counts as a row, and as an anchor. Anchors without positives, positives
    without negatives and empty tables give no rows.
    """
    named = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(F.expr(anchors), F.lit(False)).alias("anchor"), F.col(vec_col).alias("vector")
    )
    table, width = quantised(named, "vector", scale)
    table = scratch.save(table.withColumn("at", F.monotonically_increasing_id()), "numbered")
    sample = matrix(table.orderBy(F.xxhash64("id"), "at").limit(SAMPLE).select("__q").toArrow().column("__q").combine_chunks(), width)

    def longest(batches):
        for batch in batches:
            x = matrix(batch.column("__q"), width).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([(x * x).sum(axis=1).max(initial=0.0)])], names=["squares"])

    most = table.select("__q").mapInArrow(longest, "squares double").agg(F.coalesce(F.max("squares"), F.lit(0.0))).first()[0]
    pivots, extra = choose(sample, most)
    n_anchors = table.where("anchor").count()
    per_block = max(1, min(PACK_ROWS, PACK_BYTES // (8 * (width + PIVOTS + 3))))
    n_blocks = -(-n_anchors // per_block)
    at_once = max(1, BROADCAST_BYTES // (per_block * 8 * (width + PIVOTS + 3) * 2))
    turns = [(i, min(i + at_once, n_blocks) - 1) for i in range(0, n_blocks, at_once)]
    chunks = scratch.save(packed(table.withColumn("block", F.lit(0)), width, pivots, extra, most), "chunks")
    dealt = table.where("anchor").repartition(max(1, n_blocks)).withColumn("block", F.spark_partition_id())
    blocks = scratch.save(packed(dealt, width, pivots, extra, None), "blocks")

    def pairs_of(batches, search):
        """Calls ``search(block's number, anchors, chunk, k)`` for each pair that a task holds."""
        kept: dict[int, Pack] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("a_pack")[k].as_py()
                if number not in kept:
                    kept[number] = Pack(batch, k, width, "a_")
                search(number, kept[number], Pack(batch, k, width), (batch, k))

    def first_positives(batches):
        found: dict[int, tuple[Pack, Best]] = {}

        def search(number, anchors, chunk, _):
            best = found.setdefault(number, (anchors, Best(positives, len(anchors.ids))))[1]
            _, most_score = brackets(anchors, chunk, most)
            a, b = np.nonzero((anchors.labels[:, None] == chunk.labels[None, :]) & (anchors.rows[:, None] != chunk.rows[None, :]) & (most_score >= best.least[:, None]))
            s = scores(anchors, chunk, a, b)
            best.add(a, s, chunk.ids[b])

        pairs_of(batches, search)
        for number, (anchors, best) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.of), number)), pa.array(best.of), pa.array(best.id), pa.array(best.score)], names=["pack", "slot", "id", "score"])

    parts = [scratch.save(met(chunks, blocks, *turn).mapInArrow(first_positives, "pack long, slot long, id long, score long"), "positives") for turn in turns]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("pack", "slot").orderBy(F.desc("score"), "id")
    firsts = union(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    listed = firsts.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("listed"))
    blocks = scratch.save(blocks.join(listed, "pack"), "asking")

    def first_negatives(batches):
        found: dict[int, tuple[Pack, Best, list]] = {}

        def search(number, anchors, chunk, at):
            if number not in found:
                listed = at[0].column("a_listed")[at[1]].values
                slot, ids, score = (listed.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slot", "id", "score"))
                found[number] = anchors, Best(negatives, len(slot)), (slot, ids, score, -((-low * score) // 100), high * score // 100)
            _, best, (slot, _, _, least, greatest) = found[number]
            # What any list of an anchor can still use lies between these.
            wanted, limit = np.full(len(anchors.ids), np.inf), np.full(len(anchors.ids), -np.inf)
            np.minimum.at(wanted, slot, np.maximum(least, best.least))
            np.maximum.at(limit, slot, greatest.astype(float))
            least_score, most_score = brackets(anchors, chunk, most)
            a, b = np.nonzero((anchors.labels[:, None] != chunk.labels[None, :]) & (most_score >= wanted[:, None]) & (least_score <= limit[:, None]))
            s = scores(anchors, chunk, a, b)
            fits = (s >= wanted[a]) & (s <= limit[a])
            a, b, s = a[fits], b[fits], s[fits]
            # The lists of an anchor lie together; each pair is tried with each of them.
            first, count = np.searchsorted(slot, a), np.searchsorted(slot, a, side="right") - np.searchsorted(slot, a)
            for j in range(int(count.max(initial=0))):
                here = np.flatnonzero(j < count)
                of = first[here] + j
                good = (s[here] >= np.maximum(least[of], best.least[of])) & (s[here] <= greatest[of])
                best.add(of[good], s[here][good], chunk.ids[b[here][good]])

        pairs_of(batches, search)
        for number, (anchors, best, (slot, ids, score, _, _)) in found.items():
            of = best.of
            columns = [np.full(len(of), number), of, anchors.ids[slot[of]], ids[of], best.id, score[of], best.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pack", "list", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    kind = "pack long, list long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    parts = [scratch.save(met(chunks, blocks, *turn).mapInArrow(first_negatives, kind), "negatives") for turn in turns]
    order = Window.partitionBy("pack", "list").orderBy(F.desc("negative_score"), "negative_id")
    ranked = union(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
