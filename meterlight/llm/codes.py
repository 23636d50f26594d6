"""Product codes of vectors, found by partial-distance search.

Vectors are cut into equal parts; each part has a codebook, and a vector's code names
the nearest entry of each. A search takes the dimensions of a part in descending order
of the codebook's variance and adds up squared differences; entries whose sum so far
strictly exceeds the best complete distance known drop out.

Codebooks have a fixed number of entries, so they pass through the driver; rows, sums
and errors stay in Spark, and each round shuffles one sum for each entry, dimension
and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.vectors import matrix, quantised

#: Vectors that meet a codebook at once; dimensions between two looks at the bound.
BLOCK, STEP = 1024, 4


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest row of ``book`` for each row of ``x``;
    of equal ones the first. Integers throughout."""
    order = np.argsort(-book.var(axis=0), kind="stable") if book.size else np.arange(book.shape[1])
    book, width = book[:, order], book.shape[1]
    entries, distances = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for low in range(0, len(x) if width else 0, BLOCK):
        part = x[low : low + BLOCK][:, order]
        some = np.zeros((len(part), len(book)), np.int64)
        for d in range(min(STEP, width)):
            some += (part[:, d, None] - book[None, :, d]) ** 2
        bound = ((part - book[some.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(some <= bound[:, None])
        total = some[row, entry]
        starts = np.searchsorted(row, np.arange(len(part)))
        for d in range(STEP, width, STEP):
            total = total + ((part[row, d : d + STEP] - book[entry, d : d + STEP]) ** 2).sum(axis=1)
            # The most promising entry of each vector is completed, which may lower the bound.
            lead = first_least(row, total, starts)
            bound = np.minimum(bound, ((part - book[entry[lead]]) ** 2).sum(axis=1))
            alive = total <= bound[row]
            row, entry, total = row[alive], entry[alive], total[alive]
            starts = np.searchsorted(row, np.arange(len(part)))
        best = first_least(row, total, starts)
        entries[low : low + BLOCK], distances[low : low + BLOCK] = entry[best], total[best]
    return entries, distances


def first_least(row: np.ndarray, total: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of the first least ``total`` of each row; rows are sorted, none is missing."""
    equal = np.flatnonzero(total == np.minimum.reduceat(total, starts)[row])
    return equal[np.searchsorted(row[equal], np.arange(len(starts)))]


def encode(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(coded, codebooks): the columns of ``rows`` but the vector, with ``__code``, the
    numbers of the nearest entries in the order of parts as two or more hex digits each, and ``__error``,
    the squared distance to them; one integer array (entry, position) for each part.

    Components become floor(scale * x). The first codebooks are the vectors of the
    ``entries`` least ids (all, if fewer; null ids last, equal ids by components).
    Each round moves every entry to the floor of the mean of what is nearest to it, ties to
    the lower number; unused entries stay.

    Rows with a null vector, a null or non-finite component, or components too large for
    64-bit distances are left out. Shorter vectors are filled up with zeros to the
    length of the longest, and that to a multiple of ``parts``. Repeated rows each come out
    and count. No rows: no rows, and codebooks without entries.
    """
    plain, own_id, own_vec = scratch.renamed(rows, id_col, vec_col)
    table, longest = quantised(plain, own_vec, scale)
    width = -(-longest // parts)
    first = table.orderBy(F.col(own_id).asc_nulls_last(), "__q").limit(entries).select("__q").toArrow()
    start = matrix(first.column("__q").combine_chunks(), width * parts)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    if len(start):
        for _ in range(rounds):
            books = moved(table, books)
    digits = max(2, len(f"{max(0, len(start) - 1):x}"))
    schema = T.StructType([*[f for f in table.schema.fields if f.name not in ("__q", "__n")], T.StructField("__code", T.StringType()), T.StructField("__error", T.LongType())])

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 2), width * parts)
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                found, far = nearest(x[:, p * width : (p + 1) * width], book)
                code, error = code + np.array([f"{e:0{digits}x}" for e in found], object), error + far
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(code, pa.string()), pa.array(error)], names=schema.names)

    coded = scratch.save(table.mapInArrow(run, schema), "coded")
    scratch.discard(table)
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns) if f"c{i}" != own_vec]
    return coded.select(*named, "__code", "__error"), books


def moved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows."""
    width = books[0].shape[1]

    def run(batches):
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = matrix(batch.column("__q"), width * len(books))
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                found, _ = nearest(own, book)
                np.add.at(sums[p], found, own)
                counts[p] += np.bincount(found, minlength=len(book))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            shape = (len(used), width)
            flat = lambda a: pa.array(np.broadcast_to(a, shape).ravel())
            yield pa.RecordBatch.from_arrays(
                [flat(np.int64(p)), flat(used[:, None]), flat(np.arange(width)[None, :]), pa.array(sums[p][used].ravel()), flat(counts[p][used][:, None])],
                names=["part", "entry", "position", "total", "n"],
            )

    sums = table.select("__q").mapInArrow(run, "part long, entry long, position long, total long, n long")
    means = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow().to_pydict()
    out = [b.copy() for b in books]
    for p, e, d, total, n in zip(*(means[c] for c in ("part", "entry", "position", "total", "n"))):
        out[p][e, d] = total // n
    return out
