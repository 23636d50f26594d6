"""Hashes and canonical names that identify calls, models and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a project id, longest path and url.
PROJECT_DIGITS, LONGEST_PATH, LONGEST_URL = 24, 32_767, 8192
_DEFAULT_PORTS = {"http": "80", "https": "443"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(text: Column) -> Column:
    """ASCII letters folded, as in a NOCASE comparison; others are kept apart."""
    return F.translate(text, _UPPER, _LOWER)


def identity_hash(kind: str, *values: Column) -> Column:
    """Hex SHA-256 of kind and values, parted by NUL."""
    return F.sha2(F.concat_ws("\x00", F.lit(kind), *values), 256)


def stable_ordinal(value: Column) -> Column:
    """31 bits of the first four bytes, little-endian, of a value's SHA-256."""
    digest = F.sha2(value, 256)
    turned = F.concat(*[F.substring(digest, at, 2) for at in (7, 5, 3, 1)])
    return F.conv(turned, 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def plain_name(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def own_name(model: Column, agent: Column, provider: Column) -> Column:
    """A model's name without leading ``agent/`` and ``provider/``, however often."""
    parts = F.split(plain_name(model), "/")
    known = F.array(F.coalesce(plain_name(agent), F.lit("")), F.coalesce(plain_name(provider), F.lit("")))
    n = F.size(parts)
    # The first part that isn't such a prefix; a prefix needs something after it.
    first = F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at(parts, i) == "") | ~F.array_contains(known, F.element_at(parts, i)) | (i == n) | ((i == n - 1) & (F.element_at(parts, n) == ""))))
    return F.when(n > 0, F.array_join(F.slice(parts, first, n), "/"))


def canonical_models(rows: DataFrame, global_aliases: DataFrame, market_aliases: DataFrame, *, model: str = "raw_model", agent: str = "agent_id", provider: str = "provider_id") -> DataFrame:
    """``rows`` with canonical_model: the reviewed alias (alias, canonical) of its own
    name, else the market's alias, else a bare k2 to k9 family named kimi-, else itself.
    Aliases are unique small tables."""
    named = rows.withColumn("__name", own_name(F.col(model), F.col(agent), F.col(provider)))
    for i, aliases in enumerate((global_aliases, market_aliases)):
        one = aliases.groupBy(plain_name(F.col("alias")).alias("__name")).agg(F.min("canonical").alias(f"__c{i}"))
        named = named.join(F.broadcast(one), "__name", "left")
    bare = F.when(F.col("__name").rlike(r"^k[2-9]([-.].*)?$"), F.concat(F.lit("kimi-"), "__name"))
    return named.withColumn("canonical_model", F.coalesce("__c0", "__c1", bare, "__name")).drop("__name", "__c0", "__c1")


def source_models(rows: DataFrame, source_aliases: DataFrame, *, alias: str = "raw_model", agent: str = "agent_id") -> DataFrame:
    """``rows`` with source_model: the canonical name that the agent's own alias
    (agent_id, alias, canonical) has, null without one."""
    one = source_aliases.groupBy(plain_name(F.col("agent_id")).alias("__agent"), plain_name(F.col("alias")).alias("__alias")).agg(F.min("canonical").alias("source_model"))
    on = (plain_name(rows[agent]) == F.col("__agent")) & (plain_name(rows[alias]) == F.col("__alias"))
    return rows.join(F.broadcast(one), on, "left").drop("__agent", "__alias")


#: How a call's model is known.
MODEL_LOGGED, MODEL_OF_PROVIDER, MODEL_ALIASED, MODEL_UNKNOWN = 0, 1, 2, 5


def _bare(name: Column) -> Column:
    """A name's letters and digits alone, null if it has none."""
    return F.nullif(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def shown_models(rows: DataFrame, source_aliases: DataFrame, global_aliases: DataFrame, market_aliases: DataFrame, *, agent: str) -> DataFrame:
    """``rows`` of an agent's calls (raw_model, route_model_id, display_name, provider_id) with
    normalized_model and resolution_origin. A display name, or the route where both have the same letters and digits,
    stands for the raw name if it is, as written or in letters and digits, the raw name or the route, or
    the agent's own alias of one of them. What is left is named by ``canonical_models``. Nulls and
    blanks name nothing; rows that have no name keep null and an unknown origin."""
    out = rows.withColumns({"agent_id": F.lit(agent), "__raw": plain_name(F.col("raw_model")), "__route": plain_name(F.col("route_model_id")), "__shown": plain_name(F.col("display_name"))})
    for name in ("__raw", "__route"):
        out = source_models(out, source_aliases, alias=name).withColumnRenamed("source_model", f"{name}_alias")
    bare = {n: _bare(F.col(n)) for n in ("__raw", "__route", "__shown")}
    meant = F.when(F.col("__shown").isNotNull() & F.col("__route").isNotNull() & bare["__shown"].eqNullSafe(bare["__route"]), F.col("__route")).otherwise(F.col("__shown"))
    out = out.withColumn("__meant", meant)
    known = F.lit(False)
    for other in ("__raw", "__route", "__raw_alias", "__route_alias"):
        known |= F.coalesce(F.col(other) == F.col("__meant"), F.lit(False))
    for other in ("__raw", "__route"):
        known |= F.coalesce(bare[other] == _bare(F.col("__meant")), F.lit(False))
    out = out.withColumn("__name", F.when(known & F.col("__raw").isNotNull(), F.col("__meant")).otherwise(F.col("__raw")))
    aliased = F.col("__name") != F.col("__raw")
    origin = F.when(F.col("__raw").isNull(), MODEL_UNKNOWN).when(aliased, MODEL_ALIASED).when(plain_name(F.col("provider_id")).isNotNull(), MODEL_OF_PROVIDER).otherwise(MODEL_LOGGED)
    out = out.withColumn("resolution_origin", origin).withColumnRenamed("__name", "__own")
    named = canonical_models(out, global_aliases, market_aliases, model="__own")
    return named.withColumn("normalized_model", F.col("canonical_model")).drop("canonical_model", "__own", "__raw", "__route", "__shown", "__meant", "__raw_alias", "__route_alias")


def dated_model(model: Column) -> Column:
    """A model's name after the last slash, without a date at its end."""
    return F.nullif(F.regexp_replace(F.substring_index(F.lower(F.trim(model)), "/", -1), r"-(\d{4}-\d{2}-\d{2}|\d{8})$", ""), F.lit(""))


def project_path(cwd: Column) -> Column:
    """An absolute path without separators at its end; null for others, for
    control characters and for overlong ones. Roots keep theirs."""
    whole = (F.length(cwd) <= LONGEST_PATH) & cwd.rlike(r"^(?:/|[A-Za-z]:[\\/]|\\\\[^\\/\p{Cc}]+[\\/][^\\/\p{Cc}])\P{Cc}*+\z")
    cut = F.rtrim(cwd, F.lit("\\/"))
    drive = (F.length(cut) == 2) & cut.rlike("^[A-Za-z]:")
    return F.when(whole, F.when(cut == "", F.lit("/")).when(drive, F.concat(cut, F.lit("\\"))).otherwise(cut))


def repository(url: Column) -> Column:
    """HOST/path of a repository's http, ssh, git, file or scp-like url; null for others."""
    value = F.when((F.length(url) <= LONGEST_URL) & ~url.rlike(r"\p{Cc}"), F.trim(url))
    cleaned = lambda p: F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), r"(?i)\.git$", "")
    path = lambda p: F.nullif(F.regexp_replace(cleaned(p), "/+$", ""), F.lit(""))
    pattern = r"^(?i)(https?|ssh|git)://(?:[^/@]*@)?([^/:?#]+)(?::(\d+))?(/[^?#]*)?"
    scheme, host, port = F.lower(F.regexp_extract(value, pattern, 1)), F.regexp_extract(value, pattern, 2), F.regexp_extract(value, pattern, 3)
    usual = F.lit(False)
    for name, number in _DEFAULT_PORTS.items():
        usual |= (scheme == name) & (port == number)
    authority = F.upper(F.when((port == "") | usual, host).otherwise(F.concat(host, F.lit(":"), port)))
    scp = r"^(?:[^:]*@)?([^:@\s]+):(.+)$"
    return (
        F.when(value.rlike(pattern), F.concat(authority, F.lit("/"), path(F.regexp_extract(value, pattern, 4))))
        .when(value.rlike("(?i)^file://"), F.concat(F.lit("file/"), F.upper(project_path(F.regexp_replace(value, "(?i)^file://", "")))))
        .when(~value.contains("://") & value.rlike(scp), F.concat(F.upper(F.regexp_extract(value, scp, 1)), F.lit("/"), path(F.regexp_extract(value, scp, 2))))
    )


def project(cwd: Column, url: Column) -> Column:
    """(path, repository_hash, id) of a project: the id is of the repository, else of
    the path with its letters upper-cased; null without a path."""
    path, known = project_path(cwd), identity_hash("repository", repository(url))
    digest = F.when(repository(url).isNotNull(), known)
    own = F.substring(F.coalesce(digest, F.sha2(F.upper(path), 256)), 1, PROJECT_DIGITS)
    return F.when(path.isNotNull(), F.struct(path.alias("path"), digest.alias("repository_hash"), own.alias("id")))
