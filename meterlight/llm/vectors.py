"""Vectors as integers, inside tasks and as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch

#: Sum of squared components from which a vector takes no part: squared distances and
#: inner products of shorter ones fit into 64 bits.
MOST_SQUARES = 2.0**60


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(numbers of the rows that stay, their components floor(scale * x) as little-endian
    int64, their lengths). Rows that are null, hold a null or non-finite component, or
    reach ``MOST_SQUARES`` don't stay."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    with np.errstate(all="ignore"):
        scaled = np.floor(values * scale)
        squares = np.bincount(owner, weights=np.where(np.isfinite(values), scaled * scaled, np.inf), minlength=len(column))
    stays = (squares < MOST_SQUARES) & column.is_valid().to_numpy(zero_copy_only=False)
    whole = np.where(stays[owner], scaled, 0).astype("<i8")[stays[owner]]
    ends = np.zeros(int(stays.sum()) + 1, np.int32)
    np.cumsum(lengths[stays] * 8, out=ends[1:])
    packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(whole)])
    return np.flatnonzero(stays), packed, lengths[stays]


def matrix(packed: pa.Array, width: int) -> np.ndarray:
    """Rows of packed components, each filled up with zeros to ``width``."""
    rows = packed.to_pylist()
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row) // 8] = np.frombuffer(row, "<i8")
    return out


def quantised(rows: DataFrame, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(table, width): the columns of ``rows`` but ``vec_col``, with ``__q``, the packed
    integers, and ``__n``, how many they are, of the rows whose vectors take part
    (see ``integers``); width is the largest ``__n``. The table is saved."""
    plain = rows.drop(vec_col)
    schema = T.StructType([*plain.schema.fields, T.StructField("__q", T.BinaryType()), T.StructField("__n", T.LongType())])

    def run(batches):
        for batch in batches:
            stays, packed, lengths = integers(batch.column(batch.num_columns - 1), scale)
            kept = batch.take(pa.array(stays))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], packed, pa.array(lengths)], names=schema.names)

    saved = scratch.save(rows.select(*plain.columns, vec_col).mapInArrow(run, schema), "quantised")
    return saved, saved.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]
