"""LM scoring: masked pseudo-likelihood by a bidirectional window network.

Every word is predicted from the words on both sides; the log-probabilities of a
document's words are summed. Words beyond the vocabulary share a few hashed ids, and are then
spelled: a model of byte pairs, of all words of the corpus, gives each its own probability.
The network sums position-wise embeddings of its window, applies tanh, and has a
softmax of two levels: the class of a word, then the word in the class.

Training covers the whole corpus in rounds of parameter averaging: each task
trains a copy of the network on its own documents, and the copies are summed up
in groups of bounded size, level by level. In ``STRIDE`` rounds every word is predicted
once. Copies that see fewer words learn less between two averages, so results depend
somewhat on how the input is cut into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.words import NONSPACE, Powers, groups, hashes, mix, split

#: Ids: SHARED hashed ones for rare words, then the most frequent words.
CLASSES, MEMBERS, SHARED = 64, 64, 64
VOCABULARY = CLASSES * MEMBERS
#: Words seen on each side, width of the network, rounds of averaging.
SIDE, WIDTH, ROUNDS = 2, 32, 2
#: Every word is context; a round predicts one word in STRIDE, each round others.
STRIDE = 2
BATCH, RATE = 4096, 0.15
#: Bound on values below which float32 holds their exponentials, sums and inverses.
SAFE = 75.0
#: Bytes, and the mark of a word's start or end.
MARKS = 257
#: Distinct words that a task counts together, floats of a chunk of parameters, copies summed together.
COUNTED, CHUNK, FAN_IN = 1_000_000, 8192, 32
SHAPES = {"e": (2 * SIDE, VOCABULARY + 1, WIDTH), "b": (WIDTH,), "c": (WIDTH + 1, CLASSES), "m": (CLASSES, WIDTH + 1, MEMBERS)}


class Network:
    def __init__(self, flat=None) -> None:
        import numpy as np

        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0.1 if k == "e" else 0.0)).astype(np.float32) for k, s in SHAPES.items()])
        self.flat, at = np.array(flat, np.float32), 0
        self.parts = {}
        for k, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.parts[k] = self.flat[at : at + n].reshape(shape)
            at += n
        self.squares = {k: np.full(v.shape[: 2 if k == "e" else 1], 1e-2, np.float32) for k, v in self.parts.items()}

    def hidden(self, context):
        import numpy as np

        h = np.ones((len(context), WIDTH + 1), np.float32)
        x = self.parts["e"][0].take(context[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            x += self.parts["e"][j].take(context[:, j], axis=0)
        x += self.parts["b"]
        np.tanh(x, out=h[:, :WIDTH])
        return h

    @staticmethod
    def softmax(z, target, bound=None):
        """log p(target) of each row; turns z into all probabilities times their sum, which it returns
        too. ``bound``: what no value of z exceeds either way; where it is small, exp needs no maximum."""
        import numpy as np

        if bound is None or not bound < SAFE:
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), target]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        return own - np.log(total), total

    def bound(self, name: str) -> float:
        """The most that a product with hidden units, which are at most 1, comes to."""
        import numpy as np

        return float(np.abs(self.parts[name]).sum(axis=-2).max())

    def log_probabilities(self, context, target, learn: bool = False):
        """log p(target | context) of each row; with ``learn``, one step of descent."""
        import numpy as np

        # Rows by class, so that those of a class are a slice.
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
        context, target = context[order], target[order]
        h, kind, member = self.hidden(context), target // MEMBERS, target % MEMBERS
        rows = np.arange(len(target))
        by_class = h @ self.parts["c"]
        by_member = np.empty((len(target), MEMBERS), np.float32)
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
        slices = [(k, slice(bounds[k], bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds))]
        for k, own in slices:
            np.matmul(h[own], self.parts["m"][k], out=by_member[own])
        (of_class, sums), (of_member, sums_) = self.softmax(by_class, kind, self.bound("c")), self.softmax(by_member, member, self.bound("m"))
        out = np.empty_like(of_class)
        out[order] = of_class + of_member
        if learn:
            by_class /= sums[:, None]
            by_class[rows, kind] -= 1
            by_member /= sums_[:, None]
            by_member[rows, member] -= 1
            dh = by_class @ self.parts["c"].T
            self.step("c", h.T @ by_class / len(target))
            dm = np.zeros_like(self.parts["m"])
            for k, own in slices:
                np.matmul(h[own].T, by_member[own], out=dm[k])
                dh[own] += by_member[own] @ self.parts["m"][k].T
            dm /= len(target)
            self.step("m", dm)
            dx = dh[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2) / len(target)
            self.step("b", dx.sum(axis=0))
            for j in range(2 * SIDE):
                order = np.argsort(context[:, j].astype(np.uint16), kind="stable")
                ids = context[order, j]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                seen = ids[first]
                grad = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
                self.squares["e"][j][seen] += np.einsum("ij,ij->i", grad, grad) / WIDTH
                self.parts["e"][j][seen] -= RATE * grad / np.sqrt(self.squares["e"][j][seen])[:, None]
        return out

    def step(self, name: str, grad) -> None:
        import numpy as np

        axes = tuple(range(1, grad.ndim))
        self.squares[name] += (grad**2).mean(axis=axes) if axes else grad**2
        self.parts[name] -= RATE * grad / np.sqrt(self.squares[name]).reshape(-1, *[1] * len(axes))


def windows(ids, owner):
    """The words around each word of the same text, or the mark VOCABULARY."""
    import numpy as np

    out = np.full((len(ids), 2 * SIDE), VOCABULARY, np.int64)
    for j in range(1, SIDE + 1):
        same = owner[j:] == owner[:-j]
        out[j:, SIDE - j] = np.where(same, ids[:-j], VOCABULARY)
        out[:-j, SIDE + j - 1] = np.where(same, ids[j:], VOCABULARY)
    return out


def byte_pairs(data, starts, ends):
    """For each byte of words the byte before it in the word, or the mark of its start."""
    import numpy as np

    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    before[starts] = MARKS - 1
    return before


def counts(docs: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
    """Hashes of the most frequent words of the corpus, most frequent first, and the counts
    of the pairs of bytes (first * MARKS + second) in all words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(kind, words, counted):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), kind, np.int32)), pa.array(words), pa.array(counted)], names=["kind", "word", "n"])

        cache, held, pairs = Powers(), [], np.zeros(MARKS * MARKS, np.int64)

        def merged(held):
            words, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *[w for w, _ in held]]), return_inverse=True)
            return words, np.bincount(inverse, np.concatenate([np.zeros(0), *[n for _, n in held]]), len(words)).astype(np.int64)

        for batch in batches:
            for _, data, offsets in groups(batch.column("text")):
                starts, ends, _ = split(data, offsets, NONSPACE)
                if not len(starts):
                    continue
                inside = np.flatnonzero(NONSPACE[data])
                pairs += np.bincount(byte_pairs(data, starts, ends)[inside] * MARKS + data[inside], minlength=MARKS * MARKS)
                pairs += np.bincount(data[ends - 1].astype(np.int64) * MARKS + MARKS - 1, minlength=MARKS * MARKS)
                held.append(np.unique(hashes(data, starts, ends, cache).view(np.int64), return_counts=True))
                # Merged once there may be too many, not with each group of texts.
                if sum(len(w) for w, _ in held) > 2 * COUNTED:
                    held = [merged(held)]
                    if len(held[0][0]) > COUNTED:
                        yield rows(0, *held[0])
                        held = []
        yield rows(0, *merged(held))
        known = np.flatnonzero(pairs)
        yield rows(1, known, pairs[known])

    summed = docs.select("text").mapInArrow(run, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    summed = scratch.save(summed, "counts")
    words = [r[0] for r in summed.where("kind = 0").orderBy(F.desc("n"), "word").select("word").limit(VOCABULARY - SHARED).collect()]
    # At most MARKS * MARKS rows.
    pairs = sorted((r[0], r[1]) for r in summed.where("kind = 1").select("word", "n").collect())
    scratch.discard(summed)
    return words, pairs


def spelling(pairs: list[tuple[int, int]]):
    """log-probability of each byte, or the end, after each byte, or the start."""
    import numpy as np

    table = np.full(MARKS * MARKS, 0.5)
    for at, n in pairs:
        table[at] += n
    table = table.reshape(MARKS, MARKS)
    return np.log(table / table.sum(axis=1, keepdims=True))


def encode(docs: DataFrame, words: list[int], pairs: list[tuple[int, int]]) -> DataFrame:
    """(id, ids, spelled) of each row: two bytes for each word, and the summed
    log-probability of the spelling of words beyond the vocabulary, given that they share
    an id (each has about one in SHARED of all strings)."""
    known = docs.sparkSession.sparkContext.broadcast((words, pairs))
    schema = T.StructType([docs.schema["id"], T.StructField("ids", T.BinaryType()), T.StructField("spelled", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        listed, cache = np.array(known.value[0], np.int64), Powers()
        order, letters = np.argsort(listed), spelling(known.value[1])
        ranked = listed[order]
        for batch in batches:
            out, spelled = [], []
            for _, data, offsets in groups(batch.column("text")):
                starts, ends, owner = split(data, offsets, NONSPACE)
                hashed = hashes(data, starts, ends, cache).view(np.int64)
                ids = (mix(hashed.view(np.uint64)) % np.uint64(SHARED)).astype("<u2")
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, hashed), len(ranked) - 1)
                    ids = np.where(ranked[at] == hashed, order[at] + SHARED, ids).astype("<u2")
                bounds = np.searchsorted(owner, np.arange(len(offsets)))
                out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                total = np.zeros(len(data) + 1)
                np.cumsum(letters.take(byte_pairs(data, starts, ends) * MARKS + data) if len(starts) else np.zeros(len(data)), out=total[1:])
                rare = ids < SHARED
                own = total[ends[rare]] - total[starts[rare]] + letters[data[ends[rare] - 1], MARKS - 1] + np.log(SHARED)
                spelled.append(np.bincount(owner[rare], np.minimum(own, 0), len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary()), pa.array(np.concatenate([np.zeros(0), *spelled]))], names=["id", "ids", "spelled"])

    return docs.select("id", "text").mapInArrow(run, schema)


def flattened(column):
    """(ids, owner) of an Arrow column of encoded texts."""
    import numpy as np

    sizes = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def train_round(encoded: DataFrame, flat, number: int):
    """The mean of the copies that tasks train from ``flat``, weighted by words."""
    import numpy as np

    start = encoded.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        network, seen = Network(start.value), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, owner = flattened(batch.column("ids").slice(low, 256))
                context = windows(ids, owner)
                picked = np.arange((number - seen) % STRIDE, len(ids), STRIDE)
                picked = picked[np.random.default_rng(number).permutation(len(picked))]
                for i in range(0, len(picked), BATCH):
                    rows = picked[i : i + BATCH]
                    network.log_probabilities(context[rows], ids[rows], learn=True)
                seen += len(ids)
        if seen:
            task, flat_ = TaskContext.get().partitionId(), network.flat * np.float32(seen)
            chunks = range(0, len(flat_), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(chunks), pa.int64()), pa.array([i // CHUNK for i in chunks], pa.int64()), pa.array([seen] * len(chunks), pa.int64()), pa.array([flat_[i : i + CHUNK].tobytes() for i in chunks], pa.binary())],
                names=["copy", "chunk", "words", "sum"],
            )

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for copy, chunk, words, raw in zip(*[c.to_pylist() for c in batch.columns]):
                got = np.frombuffer(raw, np.float32)
                if (copy, chunk) in sums:
                    sums[copy, chunk][0] += words
                    sums[copy, chunk][1] += got
                else:
                    sums[copy, chunk] = [words, got.astype(np.float32)]
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())],
                names=["copy", "chunk", "words", "sum"],
            )

    schema = "copy long, chunk long, words long, sum binary"
    copies = scratch.save(encoded.select("ids").mapInArrow(run, schema), "copies")
    while (left := copies.select("copy").distinct().count()) > 1:
        grouped = copies.withColumn("copy", F.expr(f"copy div {FAN_IN}")) if left > FAN_IN else copies.withColumn("copy", F.lit(0).cast("long"))
        copies = scratch.save(grouped.repartition("copy", "chunk").mapInArrow(add, schema), "copies")
    rows = sorted(copies.select("chunk", "words", "sum").collect())
    return np.concatenate([np.frombuffer(r[2], np.float32) / np.float32(r[1]) for r in rows]) if rows else flat


def score(docs: DataFrame, *, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_probability) of each row: the sum over its words of the
    log-probability given the words around, 0 without words.

    Words are blank-free runs, A-Z lower-cased. Null and empty texts have no
    words. Rows that repeat count and are scored each time. An empty table gives
    no rows; a text of one word is predicted from the marks of its ends.
    """
    encoded, flat = prepare(docs, rounds, id_col, text_col)
    learned = docs.sparkSession.sparkContext.broadcast(flat)
    schema = T.StructType([encoded.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("log_probability", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        network = Network(learned.value)
        for batch in batches:
            counts, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows, 256):
                ids, owner = flattened(batch.column("ids").slice(low, 256))
                context, n = windows(ids, owner), min(256, batch.num_rows - low)
                counts[low : low + n] = np.bincount(owner, minlength=n)
                for i in range(0, len(ids), 16_384):
                    own = slice(i, i + 16_384)
                    sums[low : low + n] += np.bincount(owner[own], network.log_probabilities(context[own], ids[own]), minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(sums + batch.column("spelled").to_numpy())], names=schema.names)

    return encoded.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def prepare(docs: DataFrame, rounds: int, id_col: str, text_col: str):
    """The encoded documents (id, ids, spelled) and the parameters trained on them."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = scratch.save(encode(plain, *counts(plain)), "encoded")
    flat = Network().flat
    for number in range(rounds):
        flat = train_round(encoded, flat, number)
    return encoded, flat
