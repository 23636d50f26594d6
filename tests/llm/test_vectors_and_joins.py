"""Hard negatives, vector codes and the n-gram join against brute force, and on odd tables."""

import math
import random

import numpy as np
import pytest

from meterlight.llm import codes, ngramjoin, pivots

NAMES = "vec_id long, embedding array<float>, label int, id long, at string, pack string, q int"


def odd_vectors():
    rng = random.Random(5)
    draw = lambda n=8: [rng.gauss(0, 0.4) for _ in range(n)]
    rows = [(i, draw(), i % 3) for i in range(0, 240, 4)]
    rows += [(0, rows[0][1], 0), (0, draw(), 1), (8, rows[2][1], 2), (3, None, 1), (5, [0.5, None], 1), (6, [math.nan] * 8, 1), (7, [math.inf] + [0.0] * 7, 1), (9, draw(), None), (None, draw(), 1)]
    rows += [(11, [], 1), (12, draw(3), 2), (13, [0.0] * 8, 0), (200, [0.0] * 8, 0), (14, [1e30] + [0.0] * 7, 1), (16, [1e6] * 8, 0), (100, draw(), 2), (100, draw(), 2)]
    rows += [(300 + i, [0.25] * 8, i % 2) for i in range(20)]  # ties
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "a", None, 2) for r in odd_vectors()], NAMES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


def whole(rows, scale):
    """Rows that take part, with exact integers of one length."""
    out = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(float(np.float32(x)) * scale) for x in v]
        if sum(x * x for x in q) < 2**60:
            out.append((i, q, label))
    width = max((len(q) for _, q, _ in out), default=0)
    return [(i, q + [0] * (width - len(q)), label) for i, q, label in out]


def mined(rows, low, high):
    rows = [r for r in whole(rows, 256) if r[0] is not None and r[2] is not None]
    out = []
    for a, (i, q, label) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j, other) for b, (j, v, other) in enumerate(rows) if b != a)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fits[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("low, high", [(80, 100), (0, 150)])
def test_hard_negatives_by_brute_force(odd, low, high):
    got = sorted(map(tuple, pivots.mine(odd, low=low, high=high).collect()))
    assert got == mined(odd_vectors(), low, high) and got


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    """Blocks of a few anchors, broadcast one at a time."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], i % 4) for i in range(0, 900, 10)]
    monkeypatch.setattr(pivots, "PACK_ROWS", 4)
    monkeypatch.setattr(pivots, "BROADCAST_BYTES", 1)
    got = sorted(map(tuple, pivots.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    rows = [(i, [x for x in v], label) for i, v, label in rows]
    exact = [(i, [math.floor(x * 256) for x in v], label) for i, v, label in rows]
    want = []
    for i, q, label in exact:
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j, other) for j, v, other in exact if j != i)
            for s, j, _ in [x for x in scored if x[2] == label][:5]:
                fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
                want += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fits[:5], 1)]
    assert got == sorted(want)


def test_brackets_hold_every_score():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (80, 12))
    most = float((x * x).sum(axis=1).max())
    chosen, extra = pivots.choose(x[:40], most)
    pack = lambda rows, aug: type("P", (), {"ids": rows, "squares": (rows.astype(float) ** 2).sum(axis=1), "distances": pivots.distances(rows, aug, chosen, extra)})
    low, high = pivots.brackets(pack(x[:9], np.zeros(9)), pack(x, pivots.augmenting(x, most)), most)
    exact = x[:9] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.isclose(high, exact, atol=1 + 1e-6 * most).any() and (high - low).min() < most


def coded(rows, entries, rounds, parts=4):
    rows = whole(rows, 1024)
    width = -(-max((len(q) for _, q, _ in rows), default=0) // parts)
    cut = lambda q: [(q + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)]
    ids = [r[0] for r in rows]
    x = [cut(q) for _, q, _ in rows]
    first = sorted(range(len(rows)), key=lambda k: (ids[k] is None, ids[k] or 0, np.array(rows[k][1], "<i8").tobytes()))[:entries]
    books = [[x[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda p: [min((far(v[p], c), e) for e, c in enumerate(books[p])) for v in x]
    for _ in range(rounds):
        for p in range(parts):
            found = [e for _, e in near(p)]
            for e in set(found):
                own = [v[p] for v, f in zip(x, found) if f == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes_ = [near(p) for p in range(parts)]
    return sorted((str(ids[k]), "".join(f"{codes_[p][k][1]:02x}" for p in range(parts)), sum(codes_[p][k][0] for p in range(parts))) for k in range(len(rows))), books


@pytest.mark.parametrize("entries, rounds", [(256, 4), (7, 4), (3, 0)])
def test_codes_by_brute_force(odd, entries, rounds):
    got, books = codes.encode(odd, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "label", "id", "at", "pack", "q", "__code", "__error"]
    want, want_books = coded(odd_vectors(), entries, rounds)
    assert sorted((str(r["vec_id"]), r["__code"], r["__error"]) for r in got.collect()) == want
    assert [b.tolist() for b in books] == want_books


def test_partial_distances_give_the_first_nearest():
    rng = np.random.default_rng(2)
    for width, entries in ((16, 256), (3, 5), (1, 40), (21, 9)):
        x, book = rng.integers(-9, 9, (700, width)), rng.integers(-9, 9, (entries, width))
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, distance = codes.nearest(x, book)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_empty_vectors(empty):
    assert pivots.mine(empty).count() == 0
    got, books = codes.encode(empty)
    assert got.count() == 0 and [len(b) for b in books] == [0] * 4


def components(rows, length, percent):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[j : j + length]) for j in range(max(1, len(words) - length + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def near_texts(seed):
    """Copies with few to many edits, texts around shared passages, and short ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randrange(30))
    bases = [[word() for _ in range(n)] for n in (90, 90, 40, 300)]
    texts = []
    for k in range(240):
        words = list(bases[k % 4])
        for _ in range(rng.randrange(9) if k % 4 < 3 else rng.randrange(25)):
            words[rng.randrange(len(words))] = "z" + str(rng.randrange(99))
        texts.append(words[: rng.randrange(len(words) - 3, len(words) + 1)])
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(15)] + passage + [word() for _ in range(15)] for _ in range(80)]
    texts += [[rng.choice("xyz") for _ in range(rng.randrange(0, 8))] for _ in range(60)]
    texts += texts[5:9] * 3
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("length, percent", [(4, 85), (2, 70)])
def test_joins_by_brute_force(spark, length, percent):
    rows = near_texts(length)
    found = ngramjoin.groups_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=length, percent=percent)
    assert sorted(map(tuple, found.collect())) == components(rows, length, percent)


def test_linked_sets_share_a_lookup():
    """Sets at the very edge of the threshold, of all small sizes."""
    rng = np.random.default_rng(8)
    for percent in (60, 85, 95):
        cuts = ngramjoin.Cuts(percent)
        for n in [*range(1, 70), 300, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for gone in range(0, max(1, n * (100 - percent) // 100 + 1), max(1, n // 20)):
                more = 0
                while 100 * (n - gone) >= percent * (n + more + 1):
                    more += 1
                if 100 * (n - gone) < percent * (n + more):
                    continue
                keep = rng.permutation(n)[gone:]
                b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
                assert np.intersect1d(ngramjoin.lookups(a, cuts), ngramjoin.lookups(b, cuts)).size


def test_odd_texts(spark):
    names = "doc_id long, text string, id long, key string, band int"
    line = "one two three four five six"
    rows = [(None, None), (None, line), (1, ""), (2, "a b"), (2, "a b"), (3, line), (4, f" {line.upper()}\n"), (5, " ".join(f"w{i}" for i in range(30_000))), (6, "\n\t "), (7, None)]
    found = ngramjoin.groups_of(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], names), length=4, percent=85).collect()
    want = [(None, 0, None), (None, 3, 3), (1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (5, 29_997, 5), (6, 0, 6), (7, 0, 7)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert ngramjoin.groups_of(spark.createDataFrame([], names)).count() == 0
