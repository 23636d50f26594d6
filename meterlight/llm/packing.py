"""Mixture-controlled packing of documents into token windows.

Every source is a queue of tokens. Windows are filled by deficit round-robin:
each window adds its quantum (window size times the queue's target share) to the
queue's deficit and takes the whole tokens of it; the fraction is carried. As the
deficit of a queue before any window is the fractional part of its cumulative
target, a task can start at any window with the right deficits. Queues hold documents
in the order of the input's tasks, so which documents share a window depends on how
the tables are cut into tasks; the shares and the filling of windows don't.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterlight.llm import scratch
from meterlight.llm.words import NONSPACE, distinct, groups

#: Sources beyond this number share queues by hash, which keep their common share; target
#: weights by source are refused then.
MAX_QUEUES = 1024
#: Cached chunks or words of a task; the cache starts anew beyond it.
CACHE_ENTRIES = 500_000
#: Bytes of text encoded together.
ENCODED_BYTES = 4 << 20
#: Rows (task, queue) up to which the queues' offsets are broadcast, at 16 bytes each.
BROADCAST_PARTS = 500_000


class WordEncoder:
    """Token ids of texts as bytes.

    A tokenizer that drops white space, folds case and splits words by a pattern
    before byte-level BPE treats every blank-free chunk alike wherever it stands,
    so each distinct chunk, and each distinct word in chunks, is encoded once.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, model: str, end_id: int) -> None:
        import json

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, conf = Tokenizer.from_str(model), json.loads(model)
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end, self.model = self.packed([end_id]), self.tokenizer.model
        steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in (conf.get("normalizer") or {}).get("normalizers", [])]
        cuts = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [(x["type"], x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in cuts]
        self.by_word = steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and kinds == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
        if self.by_word:
            self.special = [x["content"] for x in conf["added_tokens"]]
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
            # A byte that prints stands for itself, the others for characters from 256 on.
            shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
            hidden = [b for b in range(256) if b not in shown]
            self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, chunk: str) -> bytes:
        import unicodedata

        if chunk.isascii() and chunk.isalpha():
            words = [chunk.lower()]
        elif any(map(chunk.__contains__, self.special)):
            self.chunks[chunk] = got = self.packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            return got
        else:
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
            words = self.pattern.findall(text.lower())
        out = []
        for word in words:
            ids = self.words.get(word)
            if ids is None:
                shown = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
                ids = self.words[word] = self.packed([t.id for t in self.model.tokenize(shown)])
            out.append(ids)
        self.chunks[chunk] = got = b"".join(out)
        return got

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, texts) -> Iterator[bytes]:
        """The ids of each text of an Arrow array, with the end id."""
        import numpy as np

        if not self.by_word:
            for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes() + self.end
            return
        for _, data, offsets in groups(texts, ENCODED_BYTES, lower=False):
            chunks, index, bounds = distinct(data, offsets, NONSPACE)
            known = [self.chunks[c] if c in self.chunks else self.learn(c) for c in chunks.to_pylist()]
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
            firsts = np.cumsum(sizes) - sizes
            pool = np.frombuffer(b"".join(known), self.kind)
            each = sizes[index]
            after = np.concatenate([[0], np.cumsum(each)])
            ids = pool[np.repeat(firsts[index] - after[:-1], each) + np.arange(after[-1])]
            cuts = after[bounds]
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield ids[low:high].tobytes() + self.end
            if len(self.chunks) > CACHE_ENTRIES:
                self.chunks = {}
            if len(self.words) > CACHE_ENTRIES:
                self.words = {}


class Mixture:
    """Cumulative whole tokens taken from each queue before a stream position.

    Queue ``k`` follows its weight until it runs dry; then the weights of the
    rest are scaled up. The queue that lasts longest takes the tokens that the
    others' carried fractions leave over, so every window is full.
    """

    def __init__(self, totals: list[int], weights: list[int | Fraction], window: int) -> None:
        self.totals, self.total = totals, sum(totals)
        live = [k for k, n in enumerate(totals) if n]
        share = {k: Fraction(weights[k]) for k in live}
        if any(w <= 0 for w in share.values()):
            raise ValueError("weights must be positive")
        self.last = max(live, key=lambda k: (totals[k] / share[k], k)) if live else 0
        #: Positions at which the shares change; for each, (a, b, c) of every
        #: queue: it has given (a + b * position) // c tokens by then.
        self.breaks, self.lines = [], []
        at, given = Fraction(0), {k: Fraction(0) for k in range(len(totals))}
        while live:
            whole = sum(share[k] for k in live)
            line = []
            for k in range(len(totals)):
                slope = share[k] / whole if k in live else Fraction(0)
                base = given[k] - slope * at
                c = base.denominator * slope.denominator
                line.append((int(base * c), int(slope * c), c))
            self.breaks.append(at)
            self.lines.append(line)
            step = min((totals[k] - given[k]) * whole / share[k] for k in live)
            for k in live:
                given[k] += step * share[k] / whole
            at += step
            live = [k for k in live if given[k] < totals[k]]
        least = min((Fraction(line[self.last][1], line[self.last][2]) for line in self.lines), default=Fraction(1))
        #: Windows are dealt in blocks long enough for the last queue's share to
        #: exceed what the others round away; a block is one window but for many queues.
        self.block = window * max(1, -(-(len(totals) - 1) // int(max(1, window * least))))
        self.blocks = -(-self.total // self.block) if self.total else 0
        self.seen: dict[int, list[int]] = {}

    def before(self, block: int) -> list[int]:
        """Tokens of each queue in the blocks before ``block``."""
        got = self.seen.get(block)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            at = min(block * self.block, self.total)
            i = max(0, bisect_left(self.breaks, at + Fraction(1, 10**30)) - 1)
            got = [(a + b * at) // c for a, b, c in self.lines[i]] if self.lines else []
            if got:
                got[self.last] = at - sum(n for k, n in enumerate(got) if k != self.last)
            self.seen[block] = got
        return got

    def find(self, queue: int, token: int, near: int) -> int:
        """The block that holds a token of a queue; ``near`` is tried first."""
        for b in (near, near + 1):
            if b < self.blocks and self.before(b)[queue] <= token < self.before(b + 1)[queue]:
                return b
        low, high = 0, self.blocks - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.before(mid + 1)[queue] > token else (mid + 1, high)
        return low

    def pieces(self, queue: int, first: int, count: int, window: int, near: int):
        """Yield (offset in the document, length, window, offset there)."""
        done, block = 0, near
        while done < count:
            block = self.find(queue, first + done, block)
            low, high = self.before(block), self.before(block + 1)
            at = block * self.block + sum(h - x for h, x in zip(high[:queue], low[:queue])) + first + done - low[queue]
            length = min(count - done, high[queue] - first - done, window - at % window)
            yield done, length, at // window, at % window, block
            done += length


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, queue: Column) -> DataFrame:
    """Token ids of whole texts: id, queue, n, ids (little-endian, ``width`` bytes
    each), and the task with the queue's tokens that came before in that task.

    ``before`` counts in the order in which the task read its rows; the caller
    writes the result once and works on what was written.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("queue", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("before", T.LongType()),
        ]
    )

    def run(batches):
        import gc

        import pyarrow as pa
        from pyspark import TaskContext

        gc.set_threshold(200_000)  # the caches hold many objects, none of them in cycles

        encoder = WordEncoder(model.value, end_id)
        size, task, taken = encoder.kind.itemsize, TaskContext.get().partitionId(), {}
        for batch in batches:
            befores, counts = [], []
            ids = list(encoder.encode(batch.column("text")))
            for q, x in zip(batch.column("queue").to_pylist(), ids):
                counts.append(len(x) // size)
                befores.append(taken.get(q, 0))
                taken[q] = befores[-1] + counts[-1]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("queue"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([size] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(befores, pa.int64())],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 4096,
    end_id: int = 2,
    weights: dict[str | None, int | Fraction] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in windows of ``window`` tokens: the id, start, length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``weights`` gives target shares by source (1 where a source is not named);
    the default is each source's share of all tokens, so that all queues run dry
    together. Only the last window can be short.

    A null or empty text is one piece, the end id alone. A null source is a
    queue of its own. Rows that repeat are packed each time. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    source = F.col(source_col)
    listed = [r[0] for r in docs.select(source.cast("string")).distinct().limit(MAX_QUEUES + 1).collect()]
    if len(listed) <= MAX_QUEUES:
        names = sorted(listed, key=lambda s: (s is not None, s))
        number = F.create_map(*[x for i, s in enumerate(names) if s is not None for x in (F.lit(s), F.lit(i))]) if any(s is not None for s in names) else None
        queue = F.coalesce(number[source.cast("string")], F.lit(0)) if number is not None else F.lit(0)
    else:
        if weights:
            raise ValueError(f"weights need at most {MAX_QUEUES} sources")
        names = list(range(MAX_QUEUES))
        queue = F.pmod(F.xxhash64(source.cast("string")), F.lit(MAX_QUEUES)).cast("int")
    tokens = scratch.save(encode(docs, tokenizer_path, end_id, id_col, text_col, queue.cast("int")), "tokens")

    parts = tokens.groupBy("task", "queue").agg(F.sum("n").alias("of_task"))
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.save(parts.select("task", "queue", F.coalesce(F.sum("of_task").over(earlier), F.lit(0)).alias("first")), "parts")
    sums = dict(tokens.groupBy("queue").agg(F.sum("n")).collect())
    totals = [sums.get(i, 0) for i in range(len(names))]
    given = [(weights.get(s, 1) if weights else n) or 1 for s, n in zip(names, totals)]
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        plan, at = Mixture(totals, given, window), {}
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("queue", "n", "ids", "width", "first")]
            rows, cut, ids = [], [], []

            def flush():
                made = [pa.array(x, pa.int64()) for x in (zip(*cut) if cut else [()] * 5)]
                key = batch.column("id").take(pa.array(rows, pa.int64()))
                out = pa.RecordBatch.from_arrays([key, *made[:2], pa.array(ids, pa.binary()), *made[2:]], names=schema.names)
                for x in (rows, cut, ids):
                    x.clear()
                return out

            for i, (q, n, raw, width, first) in enumerate(zip(*cols)):
                wide = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                for start, length, sequence, offset, block in plan.pieces(q, first, n, window, at.get(q, 0)):
                    at[q] = block
                    rows.append(i)
                    cut.append((start, length, n, sequence, offset))
                    ids.append(wide[start : start + length].tobytes())
                    if len(rows) >= 20_000:
                        yield flush()
            yield flush()

    small = parts.count() <= BROADCAST_PARTS
    joined = tokens.join(F.broadcast(parts) if small else parts, ["task", "queue"])
    return joined.select("id", "queue", "n", "ids", "width", (F.col("first") + F.col("before")).alias("first")).mapInArrow(run, schema)
