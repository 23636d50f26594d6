"""Catalogs of models and prices from ranked sources, and the guards of their updates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.operators.pricing import RATES

#: Names of the two market sources, in order of rank.
SOURCES = ("models.dev", "litellm")
#: Providers of the second source whose prices count, the name that the first
#: source has for them, and the pattern of their own models' names.
PROVIDERS = [
    ("ai21", "ai21", "^(jamba|j2-)"),
    ("anthropic", "anthropic", "^claude"),
    ("cohere", "cohere", "^(command|c4ai)"),
    ("dashscope", "alibaba", "^qwen"),
    ("deepseek", "deepseek", "^deepseek"),
    ("gemini", "google", "^(gemini|learnlm)"),
    ("minimax", "minimax", "^minimax"),
    ("mistral", "mistral", "^(mistral|codestral|ministral|pixtral|magistral|devstral|open-mistral|open-mixtral)"),
    ("moonshot", "moonshotai", "^(kimi|moonshot)"),
    ("nvidia_nim", "nvidia", "^(nemotron|nvidia)"),
    ("openai", "openai", "^(gpt-|o[134](?:-|$)|chatgpt-|text-|code-|davinci|babbage|curie|ada|computer-use)"),
    ("perplexity", "perplexity", "^(sonar|pplx)"),
    ("watsonx", "ibm", "^(granite|ibm)"),
    ("xai", "xai", "^grok"),
    ("zai", "zhipuai", "^glm"),
]
#: Kinds of the second source's models that have prices of tokens.
MODES = ("chat", "completion", "responses", "text_completion")

_RATE = "input decimal(18,9), cached decimal(18,9), write decimal(18,9), output decimal(18,9)"
#: Prices of the first source, per million tokens; null tiers are none, and a tier's kind is context.
FIRST = f"key string, {_RATE}, tiers array<struct<kind string, threshold bigint, input decimal(18,9), output decimal(18,9), cached decimal(18,9), write decimal(18,9)>>"
#: Prices of the second, with the tiers that have any price.
SECOND = f"key string, provider string, mode string, {_RATE}, tiers array<struct<threshold bigint, input decimal(18,9), output decimal(18,9)>>"
_NUMBERS = [c.split()[0] for c in RATES.split(", ")][1:]


def plain(name: Column) -> Column:
    return F.lower(F.trim(name))


def _last(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def _qualified(key: Column) -> Column:
    at = F.instr(key, "/")
    return (at > 1) & (at < F.length(key))


# --- aliases -------------------------------------------------------------------------------


def alias_evidence(models: DataFrame, listed: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, unmapped) of model names. ``models`` (key, provider/name) are the first source's own
    models, ``listed`` (provider, key, id) what its providers offer, ``second`` (key) the other's.
    A listed name counts if it is such a key or name; a qualified key of the second source only if
    what follows its last slash is a model by itself, else it is unmapped. Evidence is (alias,
    canonical, source). Null keys count nowhere; an ill-formed key of ``models`` is refused."""
    own = models.select(plain(F.col("key")).alias("alias")).where("alias is not null").distinct()
    name = F.substring_index("alias", "/", -1)
    if own.where(~_qualified(F.col("alias")) | (F.size(F.split("alias", "/")) != 2)).limit(1).count():
        raise ValueError("a model's key isn't provider/name")
    named = own.select("alias", name.alias("canonical"))
    known = named.unionByName(named.select(F.col("canonical").alias("alias"), "canonical")).distinct()
    offered = listed.select(plain(F.col("provider")).alias("provider"), F.explode(F.array_distinct(F.array(plain(F.col("key")), plain(F.col("id"))))).alias("alias")).where("alias is not null")
    # A listed name that is a key has that key's name; a name stands for itself.
    offered = offered.join(known, "alias")
    wider = offered.where(F.col("provider").isNotNull() & ~F.startswith("alias", F.concat("provider", F.lit("/")))).select(F.concat_ws("/", "provider", "alias").alias("alias"), "canonical")
    first = known.unionByName(offered.select("alias", "canonical")).unionByName(wider)
    keys = second.select(plain(F.col("key")).alias("alias")).where("alias <> ''").distinct()
    bare = keys.where(~F.contains("alias", F.lit("/"))).select("alias", F.col("alias").alias("canonical"))
    names = named.select("canonical").unionByName(bare.select("canonical")).where("canonical <> ''").distinct()
    routed = keys.where(F.contains("alias", F.lit("/"))).select("alias", name.alias("canonical")).join(names.withColumn("__known", F.lit(True)), "canonical", "left")
    other = bare.unionByName(routed.where("__known").select("alias", "canonical"))
    evidence = first.withColumn("source", F.lit(SOURCES[0])).unionByName(other.withColumn("source", F.lit(SOURCES[1])))
    return evidence.distinct(), routed.where("__known is null").select("alias")


def alias_catalog(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, conflicts) of evidence (alias, canonical, source): aliases (alias, canonical, sources,
    corroborated by two or more) that all evidence gives one model, and conflicts (alias, canonicals,
    sources), which are left out of them. One source is enough."""
    said = evidence.select(plain(F.col("alias")).alias("alias"), plain(F.col("canonical")).alias("canonical"), "source").where("alias <> '' and canonical <> ''")
    found = said.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"), F.array_sort(F.collect_set("source")).alias("sources"))
    one = F.size("canonicals") == 1
    return found.where(one).select("alias", F.col("canonicals")[0].alias("canonical"), "sources", (F.size("sources") > 1).alias("corroborated")), found.where(~one)


def reviewed_conflicts(aliases: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewed aliases (scope, alias, canonical) that the market's name otherwise: they block an update."""
    theirs = aliases.select("alias", F.col("canonical").alias("market_canonical"), "sources")
    return reviewed.join(theirs, "alias").where("market_canonical <> canonical").select("scope", "alias", F.col("canonical").alias("reviewed_canonical"), "market_canonical", "sources")


# --- prices -----------------------------------------------------------------------------------


def _ratio(base: Column, tier: Column) -> Column:
    """A tier's multiplier within 1 to 100; that of nothing to nothing is 1, else null."""
    each = (tier / base).cast("decimal(28,18)")
    return F.when(base == 0, F.when(tier == 0, F.lit(1).cast("decimal(28,18)"))).otherwise(F.when((tier >= base) & (tier <= base * 100), each))


def _same(base: Column, tier: Column, base2: Column, tier2: Column) -> Column:
    """Whether two multipliers, both valid, are equal, without dividing."""
    return F.when(base == 0, tier2 == base2).when(base2 == 0, tier == base).otherwise(tier * base2 == tier2 * base)


def _tiered(rows: DataFrame, reason: Column) -> DataFrame:
    tier = F.when(F.size("tiers") == 1, F.col("tiers")[0])
    fit = lambda x: x.cast("decimal(9,6)")
    return rows.withColumns({"reason": reason, "long_threshold": tier["threshold"], "long_input": fit(_ratio(F.col("input"), tier["input"])), "long_output": fit(_ratio(F.col("output"), tier["output"]))})


def _first_reason() -> Column:
    """Why the tiers of a row of the first source aren't usable; null where they are, or none."""
    t = F.col("tiers")[0]
    complete = (F.size("tiers") == 1) & (t["kind"] == "context") & t["threshold"].isNotNull() & t["input"].isNotNull() & t["output"].isNotNull()
    fits = _ratio(F.col("input"), t["input"]).isNotNull() & _ratio(F.col("output"), t["output"]).isNotNull()
    out = F.when(F.col("tiers").isNull(), None).when(~F.coalesce(complete, F.lit(False)), "requires exactly one complete context tier").when(~fits, "tier rates are not valid proportional multipliers")
    for name, column in (("cache_read", "cached"), ("cache_write", "write")):
        base, tier = F.col(column), t[column]
        out = out.when(base.isNull() != tier.isNull(), f"base and tier disagree on {name} availability")
        agree = _ratio(base, tier).isNotNull() & _same(F.col("input"), t["input"], base, tier)
        out = out.when(base.isNotNull() & ~F.coalesce(agree, F.lit(False)), f"{name} tier multiplier differs from input")
    return out


def _second_reason() -> Column:
    t = F.col("tiers")[0]
    complete = (F.size("tiers") == 1) & t["input"].isNotNull() & t["output"].isNotNull() & F.col("cached").isNull() & F.col("write").isNull()
    fits = _ratio(F.col("input"), t["input"]).isNotNull() & _ratio(F.col("output"), t["output"]).isNotNull()
    none = F.col("tiers").isNull() | (F.size("tiers") == 0)
    return F.when(none, None).when(~F.coalesce(complete, F.lit(False)), "requires exactly one complete tier without cache tier fields").when(~fits, "tier rates are not valid proportional multipliers")


def _canonical(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with the model of their key's alias, else of its last part's, else that part."""
    one = aliases.select(plain(F.col("alias")).alias("__alias"), F.col("canonical").alias("__model")).dropDuplicates(["__alias"])
    whole = rows.join(one.withColumnsRenamed({"__alias": "key", "__model": "__whole"}), "key", "left")
    both = whole.withColumn("__last", _last(F.col("key"))).join(one.withColumnsRenamed({"__alias": "__last", "__model": "__end"}), "__last", "left")
    return both.withColumn("model", F.coalesce("__whole", "__end", "__last")).drop("__whole", "__end", "__last")


def _rules(rows: DataFrame, source: str) -> DataFrame:
    bare = F.col("long_threshold").isNull()
    rates = [F.col(c).alias(f"{c}_rate") for c in ("input", "cached", "write", "output")]
    return rows.select("model", F.concat(F.lit(f"{source}:"), "key").alias("rule_id"), F.lit(source).alias("source"), F.col("key").alias("source_key"), *rates, "long_threshold", *[F.when(~bare, F.col(c)).alias(c) for c in ("long_input", "long_output")])


def same_rates(a: str, b: str) -> Column:
    """Whether the rates of two joined rules are the same; no multiplier is 1."""
    value = lambda at, c: F.coalesce(F.col(f"{at}.{c}"), F.lit(1).cast("decimal(9,6)")) if c in ("long_input", "long_output") else F.col(f"{at}.{c}")
    out = F.lit(True)
    for c in _NUMBERS:
        out &= value(a, c).eqNullSafe(value(b, c))
    return out


def market_rules(first: DataFrame, second: DataFrame, aliases: DataFrame, maintained: DataFrame | None = None) -> dict[str, DataFrame]:
    """Price rules of the market, one for each model: those of ``first`` (see ``FIRST``), of several keys
    the greatest, then of ``second`` (see ``SECOND``): keys without a provider before those with,
    then the least. Keys are compared in code points.

    The second source's prices count for the ``PROVIDERS`` alone, for their own models by name, and
    not where the first source knows the model under other origins. Sources are tables: tiers that a
    plan computes make its code too large to compile, so write them first. Rows without input or output
    price don't count, but name origins. Returns ``rules`` (rule_id, source, source_key and
    ``RATES``), ``disagreements`` (model) of both sources' rates, ``unsupported`` (source,
    source_key, reason) tiers, ``excluded`` (source_key, provider, model; null for an unknown
    provider), and ``differences`` and ``shadowed`` (model) by ``maintained`` rates."""
    spark = first.sparkSession
    keyed = lambda rows: rows.withColumn("key", plain(F.col("key"))).where("key <> ''")
    top = _canonical(keyed(first).where(_qualified(F.col("key"))), aliases)
    origins = top.select("model", F.substring_index("key", "/", 1).alias("origin")).distinct()
    top = _tiered(top.where("input is not null and output is not null"), _first_reason())
    ahead = _rules(top.where("reason is null").groupBy("model").agg(F.max_by(F.struct(*[c for c in top.columns if c != "model"]), "key").alias("x")).select("model", "x.*"), SOURCES[0])

    known = spark.createDataFrame(PROVIDERS, "provider string, origin string, pattern string")
    mode = plain(F.coalesce("mode", F.lit("")))
    rows = keyed(second).where("input is not null and output is not null and provider is not null").withColumn("provider", plain(F.col("provider"))).where((mode == "") | mode.isin(*MODES))
    rows = rows.join(F.broadcast(known), "provider", "left")
    foreign = rows.where("origin is null").select(F.col("key").alias("source_key"), "provider", F.lit(None).cast("string").alias("model"))
    parts = F.split("key", "/")
    rows = _canonical(rows.where(F.col("origin").isNotNull() & ((F.size(parts) == 1) | ((F.size(parts) == 2) & (parts[0] == F.col("provider"))))), aliases)
    own = F.expr("model rlike pattern")
    excluded = foreign.unionByName(rows.where(~own).select(F.col("key").alias("source_key"), "provider", "model"))
    rows = rows.where(own).join(origins.select("model").distinct().withColumn("__listed", F.lit(True)), "model", "left").join(origins.withColumn("__ours", F.lit(True)), ["model", "origin"], "left")
    low = _tiered(rows.where("__listed is null or __ours"), _second_reason())
    best = low.where("reason is null").groupBy("model").agg(F.min_by(F.struct(*[c for c in low.columns if c != "model"]), F.struct(F.contains("key", F.lit("/")).alias("q"), "key")).alias("x")).select("model", "x.*")
    behind = _rules(best, SOURCES[1])

    rules = ahead.unionByName(behind.join(ahead.select("model"), "model", "left_anti"))
    out = {"rules": rules, "disagreements": ahead.alias("a").join(behind.alias("b"), "model").where(~same_rates("a", "b")).select("model"), "excluded": excluded}
    lost = [x.where("reason is not null").select(F.lit(s).alias("source"), F.col("key").alias("source_key"), "reason") for x, s in ((top, SOURCES[0]), (low, SOURCES[1]))]
    out["unsupported"] = lost[0].unionByName(lost[1])
    if maintained is not None:
        both = rules.alias("a").join(maintained.alias("b"), "model")
        out["shadowed"], out["differences"] = both.select("model"), both.where(~same_rates("a", "b")).select("model")
    return out


# --- updates ----------------------------------------------------------------------------------


def catalog_changes(current: DataFrame, candidate: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """(key, change) between two catalogs of unique keys: added, removed, else the first of ``kinds``
    that has a column whose values differ; keys without a change are left out."""
    columns = [c for of in kinds.values() for c in of]
    side = lambda rows, n: rows.select(key, F.lit(True).alias(f"__in{n}"), F.struct(*columns).alias(f"__x{n}"))
    both = side(current, 0).join(side(candidate, 1), key, "full")
    change = F.when(F.col("__in0").isNull(), "added").when(F.col("__in1").isNull(), "removed")
    for kind, of in kinds.items():
        same = F.lit(True)
        for c in of:
            same &= F.col(f"__x0.{c}").eqNullSafe(F.col(f"__x1.{c}"))
        change = change.when(~same, kind)
    return both.select(key, change.alias("change")).where("change is not null")


def rule_changes(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Changes of price rules by model: added, removed, or changed in rates or source."""
    one = F.lit(1).cast("decimal(9,6)")
    whole = lambda rows: rows.withColumns({c: F.coalesce(c, one) for c in ("long_input", "long_output")})
    return catalog_changes(whole(current), whole(candidate), "model", {"changed": ["rule_id", *_NUMBERS]})


def alias_changes(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Changes of aliases: added, removed, retargeted, or evidence alone."""
    return catalog_changes(current, candidate, "alias", {"retargeted": ["canonical"], "evidence": ["sources"]})


def accepted(candidate: DataFrame, changes: DataFrame, allow: Iterable[str] = (), conflicts: Iterable[DataFrame] = (), free: Iterable[str] = ("added", "evidence")) -> DataFrame:
    """``candidate`` if it may be published: ValueError where it has changes of a kind that neither ``free``
    nor ``allow`` names, or any of ``conflicts``, which nothing allows. Of reviewed aliases only
    additions are free."""
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # a row for each kind
    refused = [f"{n} {kind}" for kind, n in sorted(counts.items()) if kind not in {*free, *allow}]
    refused += [f"{n} in conflict" for n in (c.count() for c in conflicts) if n]
    if refused:
        raise ValueError(f"the update is refused: {', '.join(refused)}")
    return candidate


def check_references(aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """Price aliases (alias, priced_as) that can't be used, with the reason: ill-formed, repeated, or
    priced as a model without a rule."""
    a, b = F.col("alias"), F.col("priced_as")
    bad = a.isNull() | b.isNull() | (a == "") | (b == "") | F.contains(a, F.lit("/")) | F.contains(b, F.lit("/")) | (a == b) | (plain(a) != a) | (plain(b) != b)
    twice = aliases.groupBy("alias").agg(F.count("*").alias("__n"))
    told = aliases.join(twice, "alias", "left").join(rules.select(F.col("model").alias("priced_as"), F.lit(True).alias("__rule")).distinct(), "priced_as", "left")
    reason = F.when(bad, "ill-formed").when(F.col("__n") > 1, "repeated").when(F.col("__rule").isNull(), "no rule")
    return told.select("alias", "priced_as", reason.alias("reason")).where("reason is not null")
