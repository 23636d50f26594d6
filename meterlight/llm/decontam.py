"""Benchmark decontamination: documents against the n-grams of test items.

The windows of the items go to every task as a sorted array of hashes, in shards
of bounded size. Tasks hash all word windows of their texts, look them up, and
compare the words of every hit, so a hash collision never counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.words import ALNUM, Powers, groups, hashes, split, windows

#: Bytes of item text in one broadcast shard; more items are scanned for in more passes.
SHARD_BYTES = 16 << 20
FOUND = "__found"
FOUND_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        #: Byte spans of runs of hit words in the UTF-8 text, and their word numbers.
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


class Items:
    """The windows of some items, looked up by hash and then by their words: for each
    length the sorted hashes, and where in the items' words each window starts."""

    def __init__(self, rows: list[tuple[str, str | None]], length: int) -> None:
        import numpy as np
        import pyarrow as pa

        self.names = [name for name, _ in rows]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cache, found = Powers(), {}
        for first, data, offsets in groups(pa.array([text or "" for _, text in rows], pa.large_string())):
            starts, ends, owner = split(data, offsets, ALNUM)
            hashed = hashes(data, starts, ends, cache)
            of_item = np.minimum(np.bincount(owner, minlength=len(offsets) - 1), length)
            for n in np.unique(of_item[of_item > 0]).tolist():
                rolled = windows(hashed, n)
                at = np.flatnonzero((owner[: len(rolled)] == owner[n - 1 :]) & (of_item[owner[: len(rolled)]] == n))
                found.setdefault(n, []).append((rolled[at], np.full(len(at), len(self.parts), np.int32), at.astype(np.int32), (owner[at] + first).astype(np.int32)))
            self.parts.append((data, starts, ends))
        self.windows = {}
        for n, pieces in found.items():
            known, part, at, item = (np.concatenate(x) for x in zip(*pieces))
            order = np.argsort(known, kind="stable")
            self.windows[n] = known[order], part[order], at[order], item[order]

    def named(self, n: int, first: int, words: list[bytes]) -> set[str]:
        """The items with this window, whose hash is first found at ``first``."""
        known, part, at, item = self.windows[n]
        out, k = set(), first
        while k < len(known) and known[k] == known[first]:
            data, starts, ends = self.parts[part[k]]
            if all(data[a:b].tobytes() == w for a, b, w in zip(starts[at[k] : at[k] + n], ends[at[k] : at[k] + n], words)):
                out.add(self.names[item[k]])
            k += 1
        return out


def scan(texts, items: Items, cache: Powers):
    """(words, hit words, items, runs of hit words) of each text."""
    import numpy as np

    for _, data, offsets in groups(texts):
        starts, ends, owner = split(data, offsets, ALNUM)
        hashed = hashes(data, starts, ends, cache)
        marks = np.zeros(len(starts) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for n, (known, *_) in items.windows.items():
            rolled = windows(hashed, n)
            if not len(rolled) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            for i in np.flatnonzero((known[at] == rolled) & (owner[: len(rolled)] == owner[n - 1 :])):
                if names := items.named(n, int(at[i]), [data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n])]):
                    found.setdefault(int(owner[i]), set()).update(names)
                    marks[i] += 1
                    marks[i + n] -= 1
        hit = np.cumsum(marks[:-1]) > 0
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for k in range(len(offsets) - 1):
            low, high = bounds[k], bounds[k + 1]
            runs = []
            if k in found:
                own = np.flatnonzero(hit[low:high])
                for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    a, b = low + run[0], low + run[-1]
                    runs.append([int(starts[a] - offsets[k]), int(ends[b] - offsets[k]), int(run[0]), int(run[-1]) + 1])
            yield int(high - low), int(hit[low:high].sum()), sorted(found.get(k, ())), runs


def merge(runs: list[list[int]]) -> list[list[int]]:
    """Join runs that touch or overlap by word number."""
    out: list[list[int]] = []
    for run in sorted(runs, key=lambda r: (r[2], r[3])):
        if out and run[2] <= out[-1][3]:
            if run[3] > out[-1][3]:
                out[-1][1], out[-1][3] = run[1], run[3]
        else:
            out.append(list(run))
    return out


def _pass(docs: DataFrame, rows: list[tuple[str, str | None]], text_col: str, length: int, again: bool) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(rows)
    schema = T.StructType([f for f in docs.schema if f.name != FOUND] + [T.StructField(FOUND, FOUND_TYPE)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        items, cache, kind = Items(known.value, length), Powers(), to_arrow_type(FOUND_TYPE)
        for batch in batches:
            out = []
            earlier = batch.column(FOUND).to_pylist() if again else [None] * batch.num_rows
            for (n, hit, names, runs), old in zip(scan(batch.column(text_col), items, cache), earlier):
                if old:
                    names, runs = sorted({*names, *old["items"]}), merge(runs + old["runs"])
                    hit = sum(r[3] - r[2] for r in runs)
                out.append({"n_words": n, "n_hit": hit, "items": names, "runs": runs})
            kept = [batch.column(f.name) for f in schema if f.name != FOUND]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10) -> DataFrame:
    """``docs`` with a struct column ``__found``: n_words, n_hit, items (ids as
    sorted strings) and runs of hit words (byte start, byte end, first word, word
    after the last).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
    lower-cased. A window is ``length`` consecutive words of an item; a shorter
    item is one window, an item without words none. All occurrences count.

    Null and empty texts have no words. Null item ids are named "null"; items
    that repeat count once for each id. No items: nothing is hit. Every row of
    ``docs`` comes out once, other columns unchanged; one named ``__found`` is replaced.
    """
    plain, text = scratch.renamed(docs, text_col)
    return scratch.restored(_found(plain, items, text, item_col, item_text_col, length), docs.columns, FOUND)


def _found(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, length: int) -> DataFrame:
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).alias("text")).distinct()
    # The same weight that a shard may hold: texts, and a few dozen bytes for each item.
    weight = named.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 40), F.lit(0))).head()[0]
    shards = max(1, -(-weight // SHARD_BYTES))
    out = docs
    for i in range(shards):
        part = named if shards == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == i)
        out = _pass(out, [tuple(r) for r in part.collect()], text_col, length, i > 0)
        if i < shards - 1:
            out = scratch.save(out, "scanned")  # so that one task holds one shard at a time
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10) -> DataFrame:
    """``docs`` without contamination, its columns unchanged otherwise.

    ``remove="documents"`` leaves out documents with a hit word;
    ``remove="spans"`` cuts the runs of hit words out of the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    plain, text_col = scratch.renamed(docs, text_col)
    found = _found(plain, items, text_col, item_col, item_text_col, length)
    if remove == "documents":
        return scratch.restored(found.where(F.col(FOUND)["n_hit"] == 0), docs.columns)
    schema = plain.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, got in zip(batch.column(text_col).to_pylist(), batch.column(FOUND).to_pylist()):
                if got["runs"]:
                    raw, at, kept = text.encode(), 0, []
                    for start, end, _, _ in got["runs"]:
                        kept.append(raw[at:start])
                        at = end
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(text_col).type) if c == text_col else batch.column(c) for c in schema.names], names=schema.names)

    return scratch.restored(found.mapInArrow(run, schema), docs.columns)


