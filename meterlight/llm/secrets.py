"""Secret scans: known forms, and strings that pass a battery of randomness tests.

Candidates are runs of 20 or more characters of the base64 alphabets. Each gets
an inferred encoding and three p-values, each the chance that text of this length
written in the alphabet looks as random:

* chi-squared of the symbols' counts over the alphabet, as text prefers some symbols;
* the number of runs of one class of characters (small, capital, digit), as text
  changes class seldom;
* serial dependence of neighbouring letters, as vowels and consonants alternate in text.

They are combined by Fisher's method. Strings whose runs about the middle of the
alphabet or serial correlation are not what random symbols give don't pass, so that
counters, repeats and sorted alphabets, uniform though they are, stay out.

The p-values of all documents' candidates go through Benjamini-Hochberg control,
in strata of similar length, on a histogram of bounded size.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlight.llm import scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 12

#: Encodings from the narrowest: pattern of the whole string, alphabet, and the
#: index of coincidence of text in it (digits of numbers, words, mixed names).
ENCODINGS = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.100),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.062),
    ("base64", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.060),
]
#: Two-sided bound of the runs and serial tests (probability 0.001 under randomness).
LEAST_RANDOM_Z = 3.29
#: False discoveries among the strings reported.
FALSE_DISCOVERIES = 0.01
#: Bins of a p-value's negative decimal logarithm, for one decade, and the last decade told apart.
BINS, DECADES = 20, 40
#: In text: how often neighbours differ in class, and how often two letters are both
#: vowels or both consonants.
TEXT_CHANGES, TEXT_ALIKE = 0.2, 0.45
#: Matches summed up together.
BLOCK = 256
#: Lengths of a stratum, and the last stratum.
STRATUM, STRATA = 8, 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) in code points, leftmost and non-overlapping:
    what splitting by the pattern leaves gives the distances between matches. They
    are summed up in blocks, so a text of many matches takes time in proportion."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))), lambda p: p["match"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match")))).alias("out"))

    def spans(parts: Column) -> Column:
        sums = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["match"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        placed = F.zip_with(parts, starts, lambda x, at: F.aggregate(F.coalesce(x, F.slice(F.element_at(parts, 1), 1, 0)), F.struct(F.coalesce(at, F.lit(0)).alias("at"), none.alias("out")), step)["out"])
        return F.flatten(placed)

    # Few texts have a match: the test keeps splitting for those.
    return F.when(text.rlike(pattern), bound(blocks(pieces), spans)).otherwise(none)


def clear(found: Column, taken: Column) -> Column:
    """The spans of ``found`` that overlap none of ``taken``, which are in order."""
    parts = F.transform(F.filter(blocks(taken), lambda x: F.size(x) > 0), lambda x: F.struct(F.element_at(x, 1)["start"].alias("low"), F.element_at(x, -1)["end"].alias("high"), x.alias("items")))
    hit = lambda m, b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    return bound(parts, lambda ps: F.filter(found, lambda m: ~F.exists(ps, lambda p: (p["low"] < m["end"]) & (m["start"] < p["high"]) & F.exists(p["items"], lambda b: hit(m, b)))))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end) of each kind, in the order in which kinds are listed."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def _tests(s: Column) -> Column:
    """(score, stratum) of a candidate string: the bin of its p-value, null
    if the runs or the serial test calls it not random."""
    n = F.length(s).cast("double")
    plain = F.translate(s, "_-", "/+")
    alphabet, rate, chosen = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, pattern, letters, coincidence in reversed(ENCODINGS):
        fits = s.rlike(pattern)
        alphabet, rate, chosen = F.when(fits, letters).otherwise(alphabet), F.when(fits, coincidence).otherwise(rate), F.when(fits, name).otherwise(chosen)
    folded = F.when(chosen.isin("hex", "base36"), F.lower(plain)).otherwise(plain)
    k = F.length(alphabet).cast("double")
    values = F.transform(F.split(folded, ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)
    return F.struct(s.alias("own"), folded.alias("s"), alphabet.alias("alphabet"), k.alias("k"), rate.alias("rate"), n.alias("n"), values.alias("v"))


def _minus_log(z: Column) -> Column:
    """-ln of the normal tail above z, within a few per cent: 0.5 exp(-0.717 z - 0.416 z^2)."""
    tail = 0.5 * F.exp(-0.717 * F.abs(z) - 0.416 * z * z)
    return F.when(z >= 0, 0.6931 + 0.717 * z + 0.416 * z * z).otherwise(-F.log(1 - tail))


def _scored(t: Column) -> Column:
    """The statistics of what ``_tests`` prepared."""
    n, k, v = t["n"], t["k"], t["v"]
    squares = F.aggregate(F.split(t["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow(F.length(t["s"]) - F.length(F.replace(t["s"], c, F.lit(""))), F.lit(2.0)))
    chi = k / n * squares - n
    excess = k * t["rate"] - 1
    text_z = (chi - (k - 1) - n * excess) / F.sqrt(2 * (k - 1) + 4 * n * excess)
    middle = (k - 1) / 2
    high = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x > middle, 1.0).otherwise(0.0))
    low = n - high
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
    expected = 2 * high * low / n + 1
    runs_z = (runs - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)) / F.greatest(spread, F.lit(1e-9))
    serial_z = (serial + 1 / n) * F.sqrt(n)
    # Runs of classes of letters and digits, and letters that follow letters. Signs
    # part words in text, so they end no run.
    classes = t["own"]
    for kind, mark in (("[^A-Za-z0-9]", ""), ("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")):
        classes = F.regexp_replace(classes, kind, mark)
    steps = F.greatest(F.length(classes) - 1, F.lit(1))
    changes = F.length(F.regexp_replace(classes, r"(.)\1*+", "x")) - 1
    changes_z = (changes - TEXT_CHANGES * steps) / F.sqrt(TEXT_CHANGES * (1 - TEXT_CHANGES) * steps)
    voiced = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t["own"]), "[^a-z]", "-"), "[aeiouy]", "+"), "[a-z]", "c")
    letters = lambda x: F.length(F.replace(x, F.lit("-"), F.lit("")))
    stretches = letters(F.regexp_replace(voiced, "[+c]++", "x"))
    neighbours = letters(voiced) - stretches
    unlike = letters(F.regexp_replace(F.regexp_replace(voiced, r"\++", "x"), "c++", "y")) - stretches
    alike_z = (neighbours - unlike - TEXT_ALIKE * neighbours) / F.sqrt(F.greatest(TEXT_ALIKE * (1 - TEXT_ALIKE) * neighbours, F.lit(1.0)))
    logs = _minus_log(-text_z) + _minus_log(changes_z) + F.when(neighbours > 0, _minus_log(alike_z)).otherwise(0.0)
    minus_log = (logs - F.log(1 + logs + logs * logs / 2)) / 2.302585
    random = (F.abs(runs_z) <= LEAST_RANDOM_Z) & (F.abs(serial_z) <= LEAST_RANDOM_Z)
    score = F.when(random, F.least(F.floor(minus_log * BINS), F.lit(BINS * DECADES))).otherwise(0)
    return score.cast("int")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of each row: arrays of spans (start, end, kind, value) in
    code points, end exclusive. base: assign, access, hex by start, then kind as
    listed; added: kind random, strings that overlap no base span and pass the
    tests at the false-discovery rate over all rows.

    A null or empty text has no spans. Rows that repeat are scanned each time, and
    count each time. No candidates: nothing is added. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)

    def mark(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match")))

    marked = [mark(i, kind, spans) for i, (kind, spans) in enumerate(kinds.items())]
    first = docs.select(F.col(id_col).alias("id"), F.array_sort(F.concat(*marked)).alias("base"), matches(text, CANDIDATE).alias("found"))
    # A candidate that meets an access or hex span holds all of it.
    free = clear(F.filter("found", lambda m: ~m["match"].rlike(f"{ACCESS}|{HEX}")), F.filter("base", lambda b: b["kind"] == "assign"))
    prepared = first.withColumn("found", F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), _tests(m["match"]).alias("t"))))
    scored = F.transform(
        "found",
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(len(kinds)).alias("rank"), m["end"].alias("end"), F.lit("random").alias("kind"), m["match"].alias("match"),
            _scored(m["t"]).alias("score"), F.least(F.floor(m["t"]["n"] / STRATUM), F.lit(STRATA)).cast("int").alias("stratum"),
        ),
    )
    spans = scratch.save(prepared.select("id", "base", scored.alias("found")), "spans")
    bars = thresholds(spans.select(F.explode("found").alias("c")).select("c.stratum", "c.score"))
    bar = F.create_map(*[F.lit(x) for pair in (bars or {-1: 0}).items() for x in pair])
    passed = F.filter("found", lambda m: m["score"] >= F.coalesce(bar[m["stratum"]], F.lit(1 << 30)))
    added = F.transform(passed, lambda m: F.struct(*[m[c].alias(c) for c in ("start", "rank", "end", "kind", "match")]))
    return spans.select("id", "base", added.alias("added"))


def thresholds(candidates: DataFrame) -> dict[int, int]:
    """stratum -> least score that Benjamini-Hochberg control lets pass."""
    counts = candidates.groupBy("stratum", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("score"))
    whole = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "score", F.sum("n").over(down).alias("rank"), F.sum("n").over(whole).alias("all"))
    passing = ranked.where((F.col("score") > 0) & (F.pow(F.lit(10.0), -F.col("score") / BINS) <= FALSE_DISCOVERIES * F.col("rank") / F.col("all")))
    return dict(passing.groupBy("stratum").agg(F.min("score")).collect())


def redact(docs: DataFrame, mark: str = "[secret]", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the value of every span of ``scan`` replaced by ``mark``; ids
    must be unique, other columns stay."""
    columns = docs.columns
    docs, id_col, text_col = scratch.renamed(docs, id_col, text_col)
    spans = scan(docs, id_col=id_col, text_col=text_col).select(F.col("id").alias("__id"), F.concat("base", "added").alias("__spans"))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))
        piece = F.when(m["end"] <= acc["at"], "").otherwise(F.concat(gap, F.when(m["start"] >= acc["at"], F.lit(mark)).otherwise("")))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate(F.array_sort("__spans"), zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = joined.select(*[F.when(F.size("__spans") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
    return scratch.restored(out, columns)
