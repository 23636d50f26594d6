"""Quality classifier: interpolated modified Kneser-Ney trigrams of trusted text.

Half of the documents that labels call good are counted, whole; all others that they
call good set the thresholds. Trigram counts, continuation counts, counts of counts
and context sums are grouped tables. The loss of a word, -log p(c | a, b), is a sum of
terms that depend on one n-gram each: a term of c, one of b, c and one of a, b, c where
these were counted, and one of each context that was. So the model is one table of
n-grams and terms, and a text's loss the sum of the terms of its n-grams: both sides
are dealt into shards by the n-gram's key, looked up there, and summed by text. No model
passes through the driver.

A few insults hardly move a perplexity, so toxic documents are told by marked
words: those found in more of the documents that labels call toxic than their
languages lead to expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.words import ALNUM, NONSPACE, U64, WORD_BASE, Powers, groups, hashes, mix, split

#: Rows of the model's table in a shard, and bytes of texts whose n-grams are sorted and sent together.
SHARD_ROWS, CHUNK_BYTES = 1_000_000, 2 << 20
#: Parts of the texts that are scored one after another, as the n-grams of all would fill the disk.
PASSES = 6
#: Ranks that an approximate quantile tells apart.
RANKS = 100_000
#: Documents whose perplexity is above this quantile of held-out trusted ones are rejected.
QUANTILE = 0.995
#: Words of the language's mean loss that are added to a document, so that a few words decide little.
PRIOR_WORDS = 20
#: Deviance from which a word is marked as toxic (2 (t ln(t / m) - t + m) for t toxic documents where m are expected).
LEAST_DEVIANCE = 8.0
#: Hash of the mark before the first word.
START = 7


def keys(language, *words):
    """A 64-bit key of an n-gram (arrays of word hashes) in a language (array of numbers)."""
    import numpy as np

    total = language.astype(np.int64).view(U64) * U64(0xA24BAED4963EE407) + U64(len(words))
    for w in words:
        total = (total ^ w.astype(np.int64).view(U64)) * U64(WORD_BASE)
        total ^= total >> U64(29)
    return mix(total)


def trigrams(docs: DataFrame) -> DataFrame:
    """(language, a, b, c) of every word of docs (language, text), after two start marks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = Powers()
        for batch in batches:
            language = batch.column("language").to_numpy(zero_copy_only=False)
            for first, data, offsets in groups(batch.column("text")):
                starts, ends, owner = split(data, offsets, NONSPACE)
                c = hashes(data, starts, ends, cache).view(np.int64)
                a, b = before(c, owner)
                yield pa.RecordBatch.from_arrays([pa.array(language[first + owner], pa.int64()), *[pa.array(x, pa.int64()) for x in (a, b, c)]], names=["language", "a", "b", "c"])

    return docs.select(F.col("language").cast("long"), "text").mapInArrow(run, "language long, a long, b long, c long")


def before(c, owner):
    """The words two and one before each word of the same text, or start marks."""
    import numpy as np

    b, a = np.full(len(c), START), np.full(len(c), START)
    b[1:] = np.where(owner[1:] == owner[:-1], c[:-1], START)
    a[2:] = np.where(owner[2:] == owner[:-2], c[:-2], START)
    return a, b


def _discounts(counts: DataFrame) -> DataFrame:
    """(language, d1, d2, d3): what is taken off counts n of one, two and more; a row for each language."""
    of = counts.groupBy("language").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    # Without counts of counts to go by, half of a count is taken off.
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(i - 0.05)), F.lit(0.05))).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)]
    return of.select("language", *d)


def _off():
    return F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """``counts`` n with value, the discounted share of the context's sum, and weight, what
    the context leaves to lower orders; and (language, context, weight)."""
    taken = counts.join(F.broadcast(_discounts(counts)), "language").withColumn("off", _off())
    sums = taken.groupBy("language", *context).agg(F.sum("n").alias("all"), F.sum("off").alias("taken"))
    weights = sums.select("language", *context, "all", (F.col("taken") / F.col("all")).alias("weight"))
    near = F.broadcast(weights) if not context else weights
    valued = taken.join(near, ["language", *context]).withColumn("value", (F.col("n") - F.col("off")) / F.col("all"))
    return valued.select(*counts.columns, "value", "weight"), weights.drop("all")


def counted(docs: DataFrame) -> DataFrame:
    """(language, a, b, c, n, all, m1, m2, m3, first): trigrams with their counts, and of their
    context a, b the sum of counts and the trigrams of one, two and more; first marks one of a context.

    Trigrams are dealt by their context, so that one shuffle serves both."""
    tri = trigrams(docs).repartition("language", "a", "b").groupBy("language", "a", "b", "c").agg(F.count("*").alias("n"))
    of = Window.partitionBy("language", "a", "b")
    kinds = (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)
    return tri.select("*", F.sum("n").over(of).alias("all"), *[F.sum(k.cast("int")).over(of).alias(f"m{i + 1}") for i, k in enumerate(kinds)], (F.min("c").over(of) == F.col("c")).alias("first"))


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of (language, text): (language, a, b, c, order, whole, last), the terms of
    n-grams, and (language, base), the loss of a word that was not counted, by language.

    ``whole`` is the term of an n-gram that another word follows, as whose context it serves
    too; ``last`` that of one that ends a text. Rows of the same n-gram add up.
    """
    tri = scratch.save(counted(docs), "trigrams")
    bi = scratch.save(tri.groupBy("language", "b", "c").agg(F.count("*").alias("n")), "bigrams")
    uni = scratch.save(bi.groupBy("language", "c").agg(F.count("*").alias("n")), "unigrams")
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    rows = lambda df, order, a, b, c, whole, last: df.select("language", a.alias("a"), b.alias("b"), c.alias("c"), F.lit(order).alias("order"), whole.cast("float").alias("whole"), last.cast("float").alias("last"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")

    words = uni.groupBy("language").agg((F.count("*") + 1.0).alias("words"))
    one, left = _discounted(uni, [])
    bases = scratch.save(words.join(left, "language").select("language", (-F.log(F.col("weight") / F.col("words"))).alias("base")), "bases")
    one = scratch.save(one.join(F.broadcast(bases), "language").select("language", "c", (F.col("value") + F.exp(-F.col("base"))).alias("p"), "base"), "p1")
    two, left2 = _discounted(bi, ["b"])
    left2 = scratch.save(left2, "weights2")
    p2 = F.col("value") + F.col("weight") * F.col("p")
    term = lambda p: -F.log(p) + F.log("p") + F.log("weight")  # noqa: E731  what a counted n-gram adds to its context's weight and the lower order
    two = scratch.save(two.join(one.select("language", "c", "p"), ["language", "c"]).select("language", "b", "c", p2.alias("p"), term(p2).cast("float").alias("term")), "p2")
    scratch.discard(bi)
    scratch.discard(uni)
    off = scratch.save(_discounts(tri), "discounts")
    weight = (F.col("m1") * F.col("d1") + F.col("m2") * F.col("d2") + F.col("m3") * F.col("d3")) / F.col("all")
    lost = -F.log("weight")
    left3 = scratch.save(tri.where("first").join(F.broadcast(off), "language").select("language", "a", "b", weight.alias("weight")).select("language", "a", "b", lost.cast("float").alias("lost")), "weights3")
    # Counts are small and go through the shuffle better than what is worked out of them.
    three = tri.drop("first").join(two.select("language", "b", "c", "p"), ["language", "b", "c"]).join(F.broadcast(off), "language")
    three = three.withColumn("weight", weight).withColumn("value", (F.col("n") - _off()) / F.col("all"))
    three = scratch.save(three.select("language", "a", "b", "c", term(p2).cast("float").alias("term")), "p3")
    scratch.discard(tri)
    model = rows(one, 1, none, none, c, -F.log("p") - F.col("base"), -F.log("p") - F.col("base"))
    model = model.unionAll(rows(left2, 1, none, none, b, lost, zero)).unionAll(rows(two, 2, none, b, c, F.col("term"), F.col("term")))
    model = model.unionAll(rows(left3, 2, none, a, b, F.col("lost"), zero)).unionAll(rows(three, 3, a, b, c, F.col("term"), F.col("term")))
    return model, bases


def marked(sample: DataFrame) -> tuple:
    """Sorted hashes and weights of the toxic words of (language, text, bad)."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = Powers()
        for batch in batches:
            language, bad = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("language", "bad"))
            for first, data, offsets in groups(batch.column("text")):
                starts, ends, owner = split(data, offsets, ALNUM)
                # A text counts a word once.
                once = np.unique(np.stack([owner, hashes(data, starts, ends, cache).view(np.int64)]), axis=1)
                at = first + once[0]
                yield pa.RecordBatch.from_arrays([pa.array(language[at], pa.int64()), pa.array(bad[at], pa.int64()), pa.array(once[1])], names=["language", "bad", "word"])

    texts = sample.groupBy("language").agg(F.avg(F.col("bad").cast("double")).alias("share"))
    plain = sample.select(F.col("language").cast("long"), "text", F.col("bad").cast("long"))
    counted = plain.mapInArrow(run, "language long, bad long, word long").groupBy("language", "word").agg(F.count("*").alias("n"), F.sum("bad").alias("t"))
    expected = counted.join(F.broadcast(texts.where("share < 1")), "language").groupBy("word").agg(F.sum("t").alias("t"), F.sum(F.col("n") * F.col("share")).alias("m"))
    t, m = F.col("t"), F.col("m")
    found = expected.where((t > m) & (2 * (t * F.log(t / m) - t + m) >= LEAST_DEVIANCE)).select("word", F.log(t / m).alias("weight")).toArrow()
    words, weights = (found.column(c).to_numpy() for c in ("word", "weight"))
    order = np.argsort(words)
    return words[order], weights[order]


def toxicity(data, offsets, known, cache):
    """The weights of the marked words of each text, each word once."""
    import numpy as np

    words, weights = known
    if not len(words):
        return np.zeros(len(offsets) - 1)
    starts, ends, owner = split(data, offsets, ALNUM)
    hashed = hashes(data, starts, ends, cache).view(np.int64)
    at = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
    own, at = np.unique(np.stack([owner, at])[:, words[at] == hashed], axis=1)
    return np.bincount(own, weights[at], minlength=len(offsets) - 1)


def packed(values) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind):
    import numpy as np
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * width, "zstd"), np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def dealt(key, shards: int):
    """Where the sorted keys of each shard begin, and their end; a shard is a range of keys."""
    import numpy as np

    return np.searchsorted(key, np.array([-(-(k << 64) // shards) for k in range(shards)], U64)).tolist() + [len(key)]


class Terms:
    """Rows of a model's table, sorted by key."""

    def __init__(self, key, whole, last) -> None:
        import numpy as np

        self.key, at = np.unique(key, return_inverse=True)
        self.values = np.stack([np.bincount(at, x, len(self.key)) for x in (whole, last)]) if len(key) else np.zeros((2, 0))

    def look(self, key, last):
        """The terms of n-grams, 0 where there are none; last: 1 for those that end a text."""
        import numpy as np

        if not len(self.key):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.values[last, at], 0.0)


def model_keys(batch):
    import numpy as np

    language, a, b, c, order = (batch.column(x).to_numpy() for x in ("language", "a", "b", "c", "order"))
    key = keys(language, c)
    for n, words in ((2, (b, c)), (3, (a, b, c))):
        own = order == n
        key[own] = keys(language[own], *[w[own] for w in words])
    return key, *(batch.column(x).to_numpy().astype(np.float64) for x in ("whole", "last"))


class Scorer:
    """The losses of words one by one, by a small model held whole; ``losses`` sums them by text."""

    def __init__(self, model: tuple[DataFrame, DataFrame]) -> None:
        self.terms, self.bases = Terms(*model_keys(model[0].toArrow())), dict(model[1].collect())

    def losses(self, language, a, b, c):
        """Negative log-probability of each word c after a, b."""
        import numpy as np

        out = np.array([self.bases.get(int(x), 0.0) for x in language])
        out += self.terms.look(keys(language, c), 1) + self.terms.look(keys(language, b, c), 1) + self.terms.look(keys(language, a, b, c), 1)
        for context in ((b,), (a, b)):
            key = keys(language, *context)
            out += self.terms.look(key, 0) - self.terms.look(key, 1)
        return out


def losses(docs: DataFrame, model: tuple[DataFrame, DataFrame], toxic: tuple) -> DataFrame:
    """(key, __language, __words, __loss, __toxicity) of each row (key, __language: a number, text):
    losses are summed over the words (0 in a language without a model). The model's tables
    of terms are deleted once they are dealt into shards.

    All texts are scored, in up to ``PASSES`` parts by hash, each with the whole model."""
    terms, bases = model
    size = terms.count()
    shards, parts = max(6, -(-size // SHARD_ROWS)), max(1, min(PASSES, size // SHARD_ROWS))
    marks = docs.sparkSession.sparkContext.broadcast(toxic)
    # kind 0: terms of the model, 1: n-grams of a chunk of texts, 2: the texts of a chunk.
    sent = "shard int, kind int, chunk long, n long, keys binary, more binary"
    names = [x.split()[0] for x in sent.split(", ")]

    def row(shard, kind, chunk, n, keys_, more):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, kind, chunk, n, keys_, more), kinds)], names=names)

    def slices(kind, chunk, key, more):
        import numpy as np

        bounds = dealt(key, shards)
        for shard, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            if low < high:
                yield row(shard, kind, chunk, high - low, packed(np.diff(key[low:high], prepend=U64(0))), packed(more[low:high]))

    def model_rows(batches):
        import numpy as np

        held, n = [], 0

        def out():
            key, whole, last = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            yield from slices(0, 0, key[order], np.stack([whole, last], axis=1).astype(np.float32)[order])

        for batch in batches:
            held.append(model_keys(batch))
            n += batch.num_rows
            if n >= 500_000:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    def text_rows(batches):
        import pickle

        import numpy as np
        from pyspark import TaskContext

        cache, chunk = Powers(), TaskContext.get().partitionId() << 32
        for batch in batches:
            language = batch.column("__language").to_numpy(zero_copy_only=False)
            for first, data, offsets in groups(batch.column("text"), CHUNK_BYTES):
                starts, ends, owner = split(data, offsets, NONSPACE)
                c, n = hashes(data, starts, ends, cache).view(np.int64), len(offsets) - 1
                a, b = before(c, owner)
                own, words, some = language[first + owner], np.bincount(owner, minlength=n), np.unique(owner)
                spoken, start = language[first + some], np.full(len(some), START)
                # All but a text's last word are contexts, and so are the marks before its first.
                last = np.ones(len(owner), np.int64)
                last[:-1] = owner[1:] != owner[:-1]
                key = np.concatenate([keys(own, c), keys(own, b, c), keys(own, a, b, c), keys(spoken, start), keys(spoken, start, start)])
                ref = np.concatenate([2 * owner + last, 2 * owner + last, 2 * owner + 1, 2 * some, 2 * some]).astype(np.uint32)
                order = np.argsort(key)
                yield from slices(1, chunk, key[order], ref[order])
                facts = (batch.column("key").slice(first, n).to_pylist(), language[first : first + n], words, toxicity(data, offsets, marks.value, cache))
                yield row(chunk % shards, 2, chunk, n, pickle.dumps(facts), None)
                chunk += 1

    def look(batches):
        import numpy as np

        shard, held, terms_ = None, [], None
        for batch in batches:
            for got, kind, chunk, n, raw, more in zip(*[x.to_pylist() for x in batch.columns]):
                if got != shard:
                    shard, held, terms_ = got, [], None
                if kind == 2:
                    yield row(got, kind, chunk, n, raw, None)
                    continue
                key = np.cumsum(unpacked(raw, n, U64), dtype=U64)
                if kind == 0:
                    held.append((key, *unpacked(more, n, np.complex64).view(np.float32).reshape(n, 2).T))
                    continue
                if terms_ is None:
                    terms_, held = Terms(*(np.concatenate(x) for x in zip(*held))) if held else Terms(*[np.zeros(0, U64)] * 3), []
                ref = unpacked(more, n, np.uint32)
                sums = np.bincount(ref >> 1, terms_.look(key, ref & 1))
                yield row(got, kind, chunk, len(sums), sums.tobytes(), None)

    schema = T.StructType([docs.schema["key"], T.StructField("__language", T.LongType()), T.StructField("__words", T.LongType()), T.StructField("sum", T.DoubleType()), T.StructField("__toxicity", T.DoubleType())])

    def add(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        chunk, total, facts = None, None, None

        def out():
            key, language, words, toxic_ = facts
            sums = np.zeros(len(key))
            sums[: len(total)] = total
            return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(language, pa.int64()), pa.array(words, pa.int64()), pa.array(sums), pa.array(toxic_, pa.float64())], names=schema.names)

        for batch in batches:
            for got, kind, n, raw in zip(*[batch.column(x).to_pylist() for x in ("chunk", "kind", "n", "keys")]):
                if got != chunk:
                    if facts:
                        yield out()
                    chunk, total, facts = got, np.zeros(0), None
                if kind == 2:
                    facts = pickle.loads(raw)
                    continue
                more = np.zeros(max(n, len(total)))
                more[: len(total)] = total
                more[:n] += np.frombuffer(raw)
                total = more
        if facts:
            yield out()

    dealt_terms = scratch.save(terms.mapInArrow(model_rows, sent), "dealt")
    scratch.discard(terms)
    scored = None
    for part in range(parts):
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        both = dealt_terms.unionAll(own.select("key", "__language", "text").mapInArrow(text_rows, sent))
        summed = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(look, sent)
        found = scratch.save(summed.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(add, schema), "losses")
        scored = scored.unionAll(found) if scored is not None else found
    scratch.discard(dealt_terms)
    loss = F.when(F.col("base").isNull(), 0.0).otherwise(F.col("sum") + F.col("__words") * F.col("base"))
    known = F.broadcast(bases.withColumnRenamed("language", "__language"))  # a row for each language
    return scored.join(known, "__language", "left").select("key", "__language", "__words", loss.alias("__loss"), "__toxicity")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    quantile: float = QUANTILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """``docs`` with __words, __perplexity, __threshold, __toxicity and __kept.

    Trusted documents are those with a label of quality 1 and none of another
    value, and with toxic 0 in all their labels; a document with a null toxic is
    not trusted, and toxic only if another label says 1. Labels without that
    column call no document toxic. Every trusted document takes part, whole: half of them,
    by hash of id, are counted, all others are held out. Words are blank-free runs, A-Z
    lower-cased. A document's perplexity includes ``PRIOR_WORDS`` words of the mean loss of
    its language; it is kept unless above the ``quantile`` of the held-out documents of its
    language (where they are too few to have that quantile: or of those of all languages, as
    the excess over the mean loss), or its marked words weigh more than the ``quantile`` of the
    held-out documents of all languages. Words are marked by all toxic documents, of any
    quality, against the counted ones. Rows that repeat an id count each time.

    Null and empty texts, and languages (null is one) without held-out trusted
    documents, have no perplexity and are kept. Rows that repeat are judged each
    time. Empty tables, of documents or labels, reject nothing. Columns named like the
    added ones are replaced.
    """
    own_docs, own_text, own_lang = scratch.renamed(docs, text_col, lang_col)
    toxic = F.col(toxic_col) if toxic_col in labels.columns else F.lit(0)
    voted = labels.groupBy(F.col(label_id_col).alias("id")).agg(F.min(quality_col).alias("low"), F.max(quality_col).alias("high"), F.max(toxic).alias("toxic"), F.max(toxic.isNull()).alias("unsure"))
    bad = F.when(F.col("toxic") == 1, 1).when(F.expr("low = 1 and high = 1 and toxic = 0 and not unsure"), 0)
    known = voted.where("id is not null").select("id", bad.alias("bad")).where("bad is not null")
    known = scratch.save(known, "labels")
    near = scratch.Near(known)
    # Equal texts of a language have one key and are scored once.
    spoken = lambda lang: F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("")))
    named = lambda lang, text: F.unhex(F.sha2(F.concat_ws(":", spoken(lang).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256))
    plain = docs.select(F.col(id_col).alias("id"), spoken(lang_col).alias("language"), F.col(text_col).alias("text"), named(lang_col, text_col).alias("key"))
    counted = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)) == 0
    sample = plain.where("text is not null").join(near(known.where((F.col("bad") == 1) | counted)), "id").select("language", "text", "bad")
    model = fit(sample.where("bad = 0").select("language", "text"))
    toxic_words = marked(sample)

    scored = losses(plain.select("key", F.col("language").alias("__language"), "text"), model, toxic_words)
    scored = scratch.save(scored.groupBy("key").agg(*[F.max(c).alias(c) for c in ("__language", "__words", "__loss", "__toxicity")]), "losses")
    apart = plain.select("id", "key").join(near(known.where((F.col("bad") == 0) & ~counted)), "id").select("key")
    held = scratch.save(apart.join(scored.where("__words > 0"), "key").drop("key"), "held_out")
    models = model[1].select(F.col("language").alias("__language"))
    of = held.join(F.broadcast(models), "__language").groupBy("__language").agg((F.sum("__loss") / F.sum("__words")).alias("__mean"), F.count("*").alias("n"))
    per_word = (F.col("__loss") + PRIOR_WORDS * F.col("__mean")) / (F.col("__words") + PRIOR_WORDS)
    spread = scratch.save(held.join(F.broadcast(of), "__language").select("__language", "__mean", "n", (per_word - F.col("__mean")).alias("over")), "spread")
    at = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(RANKS))
    pooled = spread.agg(at("over")).first()[0] or 0.0
    own = spread.groupBy("__language").agg(F.first("__mean").alias("__mean"), F.first("n").alias("n"), at("over").alias("over"))
    few = F.col("n") * (1 - quantile) < 1
    bar = F.exp(F.col("__mean") + F.when(few, F.greatest(F.col("over"), F.lit(pooled))).otherwise(F.col("over")))
    # A row for each language.
    bars = scratch.save(own.select(F.col("__language").alias("__of"), "__mean", bar.alias("__threshold")), "bars")
    most = held.agg(at("__toxicity")).first()[0] or 0.0

    judged = own_docs.withColumn("__key", named(own_lang, own_text)).join(scored.withColumnRenamed("key", "__key"), "__key")
    judged = judged.join(F.broadcast(bars), F.col("__language") == F.col("__of"), "left")
    n = F.col("__words")
    perplexity = F.when((n > 0) & F.col("__mean").isNotNull(), F.exp((F.col("__loss") + PRIOR_WORDS * F.col("__mean")) / (n + PRIOR_WORDS)))
    kept = judged.select(*own_docs.columns, "__words", perplexity.alias("__perplexity"), "__threshold", "__toxicity").withColumn(
        # A hair is left for rounding, so that the document that sets a bar is within it.
        "__kept", F.coalesce(F.col("__perplexity") <= F.col("__threshold") * (1 + 1e-9), F.lit(True)) & (F.col("__toxicity") <= F.lit(most))
    )
    return scratch.restored(kept, docs.columns, "__words", "__perplexity", "__threshold", "__toxicity", "__kept")
