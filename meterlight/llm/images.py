"""Media columns: copies of images by local descriptors.

Corners on several scales get an orientation from their intensity centroid and a
256-bit string of rotated intensity tests. The bits are cut into substrings; equal
substrings at the same place put images into buckets of a Hamming table, and the
images of a bucket are compared: descriptors within the Hamming bound are matched,
and a shift, scale and rotation on which enough matches agree makes a copy, so
crops, brightness changes, noise and rescaling are found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.llm import scratch
from meterlight.llm.graph import connect
from meterlight.llm.words import BYTE_BASE, U64, mix

#: Scales of the pyramid, pixels for each of the strongest corners kept, radius of a patch.
SCALES, AREA, RADIUS = (1.0, 0.75, 0.5), 77, 7
#: Bits of a descriptor, substrings it is cut into, and the bits in which matches may differ.
BITS, TABLES, HAMMING = 256, 4, 24
#: Matches that agree on a transform, and the pixels by which they may miss it.
CONSENSUS, TOLERANCE = 6, 2.0
#: x, y, scale, angle (float32) and bits of one descriptor.
RECORD = 16 + BITS // 8


def pattern():
    """The points (256, 4) of the intensity tests, in a disk of the patch."""
    import numpy as np

    rng = np.random.default_rng(256)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS + 2, RADIUS - 2)
    return points


def blur(image):
    import numpy as np

    p = np.pad(image, 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16


def resized(image, scale: float):
    import numpy as np

    if scale == 1:
        return image
    h, w = (max(1, int(n * scale)) for n in image.shape)
    y, x = ((np.arange(n) + 0.5) / scale - 0.5 for n in (h, w))
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    a, b = y.astype(int), x.astype(int)
    c, d = np.minimum(a + 1, image.shape[0] - 1), np.minimum(b + 1, image.shape[1] - 1)
    v, u = (y - a)[:, None], (x - b)[None]
    return (image[a][:, b] * (1 - u) + image[a][:, d] * u) * (1 - v) + (image[c][:, b] * (1 - u) + image[c][:, d] * u) * v


def describe(image, points) -> bytes:
    """The descriptors of one image (2-d array), ``RECORD`` bytes each."""
    import numpy as np

    out = []
    near = np.arange(-RADIUS, RADIUS + 1)
    disk = (near[:, None] ** 2 + near[None] ** 2 <= RADIUS**2).astype(np.float32)
    for scale in SCALES:
        level = blur(resized(image.astype(np.float32), scale))
        h, w = level.shape
        if min(h, w) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(level)
        xx, yy, xy = blur(blur(gx * gx)), blur(blur(gy * gy)), blur(blur(gx * gy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[RADIUS + 1 : h - RADIUS - 1, RADIUS + 1 : w - RADIUS - 1]
        around = response[RADIUS : h - RADIUS, RADIUS : w - RADIUS]
        peak = np.ones(inner.shape, bool)
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    peak &= inner >= around[dy : dy + inner.shape[0], dx : dx + inner.shape[1]]
        y, x = np.nonzero(peak & (inner > 1e-2))
        strongest = np.argsort(-inner[y, x], kind="stable")[: -(-h * w // AREA)]
        y, x = y[strongest] + RADIUS + 1, x[strongest] + RADIUS + 1
        if not len(y):
            continue
        patches = level[y[:, None, None] + near[None, :, None], x[:, None, None] + near[None, None]] * disk
        angle = np.arctan2((patches * near[None, :, None]).sum((1, 2)), (patches * near[None, None]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        a, b = points[None, :, :2], points[None, :, 2:]
        value = []
        for p in (a, b):
            px = np.rint(x[:, None] + cos * p[..., 0] - sin * p[..., 1]).astype(int)
            py = np.rint(y[:, None] + sin * p[..., 0] + cos * p[..., 1]).astype(int)
            value.append(level[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)])
        bits = np.packbits(value[0] < value[1], axis=1)
        place = np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), scale), angle], axis=1).astype("<f4")
        out += [p.tobytes() + d.tobytes() for p, d in zip(place, bits)]
    return b"".join(out)


def agree(one: bytes, two: bytes) -> int:
    """The most matches of two sets of descriptors that agree on a similarity transform."""
    import numpy as np

    a, b = (np.frombuffer(x, np.uint8).reshape(-1, RECORD) for x in (one, two))
    if len(a) < CONSENSUS or len(b) < CONSENSUS:
        return 0
    far = np.bitwise_count(a[:, None, 16:].view("<u8") ^ b[None, :, 16:].view("<u8")).sum(axis=2)
    best = far.argmin(axis=1)
    i = np.flatnonzero((far[np.arange(len(a)), best] <= HAMMING) & (far.argmin(axis=0)[best] == np.arange(len(a))))
    if len(i) < CONSENSUS:
        return 0
    p, q = (np.ascontiguousarray(x[k, :16]).view("<f4") for x, k in ((a, i), (b, best[i])))
    # Each match votes for a transform, as it has a scale and an angle of its own.
    ratio, turn = p[:, 2] / q[:, 2], q[:, 3] - p[:, 3]
    rotate = ratio * np.exp(1j * turn)
    x, y = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    missed = np.abs(y[None] - (y[:, None] + rotate[:, None] * (x[None] - x[:, None])))
    agreed = missed <= TOLERANCE * np.maximum(1, np.abs(x[None] - x[:, None]) / 16)
    # Places count once: scales repeat corners.
    cells = np.unique(np.rint(x.real / 3) + 1j * np.rint(x.imag / 3), return_inverse=True)[1]
    return max(len(np.unique(cells[row])) for row in agreed)


def descriptors(images: DataFrame, render: Callable, id_col: str) -> DataFrame:
    """(id, key, features): key is a hash of the pixels; null without an image."""
    schema = T.StructType([T.StructField("id", images.schema[id_col].dataType), T.StructField("key", T.BinaryType()), T.StructField("features", T.BinaryType())])

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        points = pattern()
        for batch in batches:
            keys, found = [], []
            for image in render(batch):
                if image is None:
                    keys.append(None)
                    found.append(None)
                    continue
                image = np.ascontiguousarray(image, np.uint8)
                keys.append(blake2b(repr(image.shape).encode() + image.tobytes(), digest_size=16).digest())
                found.append(describe(image, points))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=schema.names)

    return images.mapInArrow(run, schema)


def substrings(features: DataFrame) -> DataFrame:
    """(band, key): places in the Hamming tables of the images (key, features)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bands, keys = [], []
            for i, raw in enumerate(batch.column("features").to_pylist()):
                parts = np.frombuffer(raw, np.uint8).reshape(-1, RECORD)[:, 16:]
                values = np.ascontiguousarray(parts).view("<u8")
                bands.append(np.unique(mix(values + np.arange(1, TABLES + 1, dtype=U64) * U64(BYTE_BASE)).view(np.int64)))
                keys.append(np.full(len(bands[-1]), i))
            if bands:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), batch.column("key").take(pa.array(np.concatenate(keys)))], names=["band", "key"])

    return features.mapInArrow(run, "band long, key binary")


def pixels(batch):
    """Images of a batch with the columns height, width and pixels (gray bytes); null,
    empty and misshapen ones are none."""
    import numpy as np

    for h, w, raw in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "pixels"))):
        whole = h and w and raw is not None and h > 0 and w > 0 and len(raw) == h * w
        yield np.frombuffer(raw, np.uint8).reshape(h, w) if whole else None


def copies(images: DataFrame, *, render: Callable = pixels, id_col: str = "id") -> DataFrame:
    """id, descriptors (count), component (least id of the group of copies) and
    same (images of equal pixels) of each row; ``render`` makes gray images (2-d
    arrays of bytes, or None) of an Arrow batch.

    Images of equal pixels are copies, and those on which ``CONSENSUS`` matches
    agree; being copies is transitive. Flat and tiny images have no descriptors
    and are copies of equal ones alone. A row without an image is alone, with its
    own id. Rows that repeat come out each time. An empty table gives no rows.
    """
    made = scratch.save(descriptors(images, render, id_col), "descriptors")
    classes = scratch.save(made.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("features").alias("features"), F.count("*").alias("same")), "images")
    places = substrings(classes.select("key", "features"))
    full = places.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = scratch.save(places.join(full, "band", "left_semi"), "buckets")
    features = classes.select("key", "features")

    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                kept = [i for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())) if agree(x, y) >= CONSENSUS]
                yield batch.take(pa.array(kept, pa.int64())).select(["src", "dst"])

        one, two = features.toDF("src", "a"), features.toDF("dst", "b")
        return pairs.join(two, "dst").join(one, "src").select("src", "dst", "a", "b").mapInArrow(run, "src binary, dst binary")

    roots = connect(buckets, verify)
    ids = classes.select("key", "id", "same").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "id", "same", F.coalesce("root", "key").alias("root"))
    least = ids.groupBy("root").agg(F.min("id").alias("component"))
    found = scratch.save(ids.join(least, "root").select("key", "same", "component"), "found")
    out = made.select("id", "key", (F.octet_length("features") / RECORD).cast("long").alias("descriptors")).join(found, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("descriptors", F.lit(0)).alias("descriptors"), F.coalesce("component", "id").alias("component"), F.coalesce("same", F.lit(1)).alias("same"))


def vector_images(batch, vector_col: str = "embedding", side: int = 56):
    """Images of vectors: fixed textures, one for each dimension, weighted by the values."""
    import numpy as np

    textures: dict[int, np.ndarray] = {}
    for v in batch.column(vector_col).to_pylist():
        if not v or None in v or not np.isfinite(v).all():
            yield None
            continue
        if len(v) not in textures:
            noise = np.random.default_rng(len(v)).standard_normal((len(v), side, side))
            textures[len(v)] = np.stack([blur(blur(t)) for t in noise])
        drawn = np.tensordot(np.asarray(v), textures[len(v)], 1)
        yield (128 + 48 * drawn / (drawn.std() or 1.0)).clip(0, 255).astype(np.uint8)
