"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Texts with equal words are one class. Banded signatures bring classes together.
Each bucket compares its classes with a hub. Classes that stay apart in a bucket can
be linked only if they have shingles in common that the hub lacks, or if one is so
short that what both share with the hub is enough; buckets of such shingles and
sizes follow, with hubs of their own. A bucket of n copies so costs about n
comparisons, and no pair of classes that could still connect two components is left
out.

A comparison reads the signatures batch by batch and stops once the posterior
probability of the wanted similarity falls under the chosen miss probability.
Pairs that survive are verified on their full shingle sets.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.graph import connect
from meterlight.llm.words import NONSPACE, U64, Powers, groups, hashes, mix, split, windows

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared before each look at the posterior.
BATCH = 32
#: Pairs of whole sets that a task compares, where there are few.
PAIRS = 1000
#: Sets up to this size are told apart by size, larger ones by steps of ``STEP``.
EXACT_SIZES, STEP = 512, 1.002
#: Keys of 16 bytes up to which a set of them is broadcast.
BROADCAST_KEYS = 250_000


@lru_cache
def least_matches(percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(n, m) for each batch end: with fewer than m of n equal hashes, the
    posterior probability of a similarity of ``percent`` or more, from a uniform
    prior, is under ``miss``."""
    import numpy as np

    grid = np.linspace(0, 1, 20_001)[1:-1]
    wanted = grid >= percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[wanted].sum() / density.sum() >= miss:
                out.append((n, m))
                break
    return tuple(out)


def shingles(texts, length: int, cache: Powers):
    """(bytes of the words, sorted distinct 64-bit shingles) of each text: runs of
    ``length`` words, or all words if fewer."""
    import numpy as np

    for _, data, offsets in groups(texts):
        starts, ends, owner = split(data, offsets, NONSPACE)
        hashed = hashes(data, starts, ends, cache)
        rolled = windows(hashed, length)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        spaced = data.copy()
        spaced[~NONSPACE[data]] = 0x20
        for k in range(len(offsets) - 1):
            low, high = bounds[k], bounds[k + 1]
            if low == high:
                yield b"", np.zeros(0, U64)
                continue
            words = b" ".join(spaced[offsets[k] : offsets[k + 1]].tobytes().split())
            if high - low < length:
                yield words, windows(hashed[low:high], int(high - low))
            else:
                yield words, np.unique(rolled[low : high - length + 1])


def text_hash(text: Column) -> Column:
    """What tells texts apart: 160 bits of hash."""
    return F.coalesce(F.sha1(text), F.lit(""))


def sign(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), key (128-bit hash of the words; null without words),
    n_shingles, bands and signature (16 bits of each minimum, little-endian) of each row."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("hash", T.StringType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("signature", T.BinaryType()),
        ]
    )

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        cache, rng = Powers(), np.random.default_rng(20)
        turns = rng.integers(1, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1)
        weights = rng.integers(1, 1 << 63, ROWS, dtype=U64) * U64(2) + U64(1)
        names = np.arange(BANDS, dtype=U64)
        for batch in batches:
            keys, counts, bands, signatures = [], [], [], []
            for words, found in shingles(batch.column("text"), length, cache):
                counts.append(len(found))
                if not len(found):
                    keys.append(None)
                    bands.append(None)
                    signatures.append(None)
                    continue
                low = np.full(HASHES, ~U64(0))
                for i in range(0, len(found), 4096):  # a bounded table of products
                    part = found[i : i + 4096]
                    np.minimum(low, (part[None, :] * turns[:, None] >> U64(16)).min(axis=1), out=low)
                keys.append(blake2b(words, digest_size=16).digest())
                bands.append(mix((low.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=U64) + names).view(np.int64))
                signatures.append((low & U64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("hash"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def survivors(pairs: DataFrame, signatures: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (src, dst) that sequential verification doesn't prune."""
    steps = least_matches(percent, miss)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("a", "b"))
            left, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, least in steps:
                equal = equal + (a[left, done:n] == b[left, done:n]).sum(axis=1)
                left, equal, done = left[equal >= least], equal[equal >= least], n
            yield batch.take(pa.array(left)).select(["src", "dst"])

    return sided(pairs, signatures, "signature").mapInArrow(run, "src binary, dst binary")


def sided(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """pairs (src, dst, saved before) with the values (key, value) of src and dst as a and
    b. Both meet by pair, so that the partner of many is no hot key."""
    near = scratch.Near(pairs)
    a = values.select(F.col("key").alias("src"), F.col(value).alias("a")).join(near(pairs), "src")
    b = values.select(F.col("key").alias("dst"), F.col(value).alias("b")).join(near(pairs.select("src", "dst")), "dst")
    both = a.join(b, ["src", "dst"]).select(*pairs.columns, "a", "b")
    return both.coalesce(near.tasks + near.rows // PAIRS) if near.few else both


def full_sets(docs: DataFrame, wanted: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(key, set) of the wanted classes (key, id): sorted 64-bit shingles."""

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        cache = Powers()
        for batch in batches:
            keys, sets = [], []
            for words, found in shingles(batch.column("text"), length, cache):
                keys.append(blake2b(words, digest_size=16).digest() if words else None)
                sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("id"), pa.array(sets, pa.binary())], names=["key", "id", "set"])

    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("set", T.BinaryType())])
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    # A class without an id has no row to match by id; any of its rows will do.
    match = (keyed["key"] == wanted["key"]) & keyed["id"].eqNullSafe(wanted["id"])
    return keyed.join(bounded(wanted), match, "left_semi").groupBy("key").agg(F.first("set").alias("set"))


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcasting if they are few, else as they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have the similarity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["src", "dst"])

    return sided(pairs, sets, "set").mapInArrow(run, "src binary, dst binary")


def size_class(n):
    import numpy as np

    return np.where(n < EXACT_SIZES, n, EXACT_SIZES + np.floor(np.log(np.maximum(n, EXACT_SIZES) / EXACT_SIZES) / np.log(STEP)).astype(np.int64))


def dealt(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The buckets (band, key, root, ask, n, i, e) of classes (key, root, lead) of which
    those of one hub ``lead`` may be links, and without a band what each was given.

    What a and b have in common lies inside the hub, where it is at most the
    smaller of their overlaps with it, or outside. So a link either has common
    shingles outside, at least as many as the class a lacks to ``percent`` of its own
    size; then the first of its outer shingles, all but one less than those, hold
    one of them, in any order that both follow. Or it has none there, and
    b's size is at most what a's overlap allows. Classes linked with the hub are one
    component, so one of a and b asks.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bands, at, facts, known = [], [], [], []
            for row, (a, b, lead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "lead")))):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                name = U64(int.from_bytes(lead[:8], "little"))
                outer = np.setdiff1d(a, b, assume_unique=True)
                n, i = len(a), len(a) - len(outer)
                linked = 100 * i >= percent * (n + len(b) - i)
                lacks = max(1, -(-percent * n // 100) - i)
                first = np.sort(mix(outer + name))[: max(0, len(outer) - lacks + 1)]
                least, most = -(-percent * n // 100), min(100 * n // percent, (100 + percent) * i // percent - n)
                own = size_class(np.array([n]))
                sizes = np.arange(size_class(np.array(least)), size_class(np.array(most)) + 1) if not linked and least <= most else own[:0]
                # A class lies in the bucket of its own size, and asks in those that its links may have.
                sized = np.concatenate([own, sizes]).astype(U64)
                bands.append(np.concatenate([first, mix(mix(sized + U64(1)) ^ name)]).view(np.int64))
                at.append(np.full(len(bands[-1]), row))
                asks = np.full(len(bands[-1]), not linked)
                asks[len(first)] = False
                outside = np.full(len(asks), len(outer))
                outside[len(first) :] = 0
                facts.append(np.stack([asks, np.full(len(asks), n), np.full(len(asks), i), outside]))
                known.append((not linked, n, i, len(outer)))
            if not bands:
                continue
            at, facts = np.concatenate([*at, np.arange(len(known))]), np.concatenate([*facts, np.array(known).T], axis=1)
            bands, at = pa.concat_arrays([pa.array(np.concatenate(bands)), pa.nulls(len(known), pa.int64())]), pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [bands, batch.column("key").take(at), batch.column("root").take(at), pa.array(facts[0].astype(bool)), pa.array(facts[1]), pa.array(facts[2]), pa.array(facts[3]), batch.column("lead").take(at)],
                names=["band", "key", "root", "ask", "n", "i", "e", "lead"],
            )

    pairs = scratch.save(members.select(F.col("key").alias("src"), F.col("lead").alias("dst"), "root"), "measured")
    rows = sided(pairs, sets, "set").withColumnsRenamed({"src": "key", "dst": "lead"}).select("key", "root", "lead", "a", "b")
    return rows.mapInArrow(run, "band long, key binary, root binary, ask boolean, n long, i long, e long, lead binary")


def classes_of(docs: DataFrame, *, length: int = 5, percent: int = 80, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): id, hash (of the text), key (of its words; null without any) and
    n_shingles of each row, and the component, a key, of each key."""
    signed = scratch.save(sign(docs, length, id_col, text_col), "signed")
    worded = signed.where("key is not null")
    classes = scratch.save(worded.groupBy("key").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")

    buckets = classes.select("key", F.explode("bands").alias("band"))
    full = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = scratch.save(buckets.join(full, "band", "left_semi"), "buckets")
    wanted = scratch.save(classes.join(buckets.select("key").distinct(), "key", "left_semi").select("key", "id", "signature"), "wanted")
    sets = scratch.save(full_sets(docs, wanted.select("key", "id"), length, id_col, text_col), "sets")
    signatures = wanted.select("key", "signature")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(scratch.save(survivors(pairs, signatures, percent, miss), "close"), sets, percent)

    roots = connect(buckets, verify, lambda members: dealt(members, sets, percent), percent)
    groups = classes.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("component"))
    groups = scratch.save(groups, "groups")
    for table in (buckets, wanted, sets, classes):
        scratch.discard(table)
    return signed.select("id", "hash", "key", "n_shingles"), groups


def groups_of(docs: DataFrame, **options) -> DataFrame:
    """id, n_shingles and component (least id of the near-duplicate group) of each
    row of ``docs``. Options: those of ``classes_of``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; documents
    whose sets of ``length``-word shingles have ``percent`` of their union in
    common are linked, and links are transitive.

    A null, empty or blank text has no shingles and is alone, with its own id as
    component. Rows that repeat an id come out each time. Null ids are never the
    least of a group with other ids. An empty table gives no rows.
    """
    rows, groups = classes_of(docs, **options)
    placed = rows.join(groups, "key", "left")
    least = placed.groupBy("component").agg(F.min("id").alias("least"))
    known = scratch.save(groups.join(least, "component").select("key", "least"), "found")
    return rows.join(known, "key", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component"))


def distinct(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays, that
    of the least id, then text hash; null ids come last. Rows without words all stay.
    Of rows equal in id and text any one stays; rows that share only an id are
    judged each by its own text. Options: those of ``classes_of``."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows, groups = classes_of(docs, **options)
    placed = scratch.save(rows.join(groups, "key").select("component", F.struct(F.col("id").isNull().alias("late"), "id", "hash").alias("row")), "placed")
    per_row = placed.groupBy("component", "row").agg(F.count("*").alias("n"))
    first = placed.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("all")).where("all > 1")
    # Only rows of groups are looked at, so that other texts needn't be shuffled.
    grouped = scratch.save(per_row.join(first, "component").select("row.id", "row.hash", (F.col("row") == F.col("first")).alias("stays"), "n"), "grouped")
    plain, own_id, own_text = scratch.renamed(docs, id_col, text_col)
    marked = plain.withColumns({"id": F.col(own_id), "hash": text_hash(F.col(own_text))})
    same = marked["id"].eqNullSafe(grouped["id"]) & (marked["hash"] == grouped["hash"])
    out = marked.join(bounded(grouped.where("not stays").select("id", "hash")), same, "left_anti")
    twice = grouped.where("stays and n > 1").select("id", "hash")
    if twice.limit(1).count():
        once = out.join(bounded(twice), same, "left_semi").groupBy("id", "hash").agg(F.first(F.struct(*plain.columns)).alias("row"))
        out = out.join(bounded(twice), same, "left_anti").select(*plain.columns).union(once.select("row.*"))
    return scratch.restored(out, docs.columns)
