"""Reading JSON records: typed fields of a variant, null where they aren't what they should be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for media in a preview, and the length of previews.
IMAGE, AUDIO, PREVIEW = "[图片]", "[音频]", 120
#: A string without control characters that isn't blank; beside these, only spaces count as blank.
PROPER = r"^ *+[^ \p{Cc}]\P{Cc}*+\z"


def record(text: Column) -> Column:
    """A JSON object as a variant; null for other JSON and for what isn't JSON."""
    return F.when(text.rlike(r"^[ \t\r\n]*+\{"), F.try_parse_json(text))


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """Type name of a field; null if absent, VOID for a JSON null."""
    return F.schema_of_variant(part(v, path))


def counter(v: Column, *paths: str) -> Column:
    """The first of the fields that is a JSON integer of 0 or more within 64 bits."""
    found = [F.when((kind(v, p) == "BIGINT") & (F.try_variant_get(v, p, "bigint") >= 0), F.try_variant_get(v, p, "bigint")) for p in paths]
    return F.coalesce(*found)


def counters_ok(v: Column, *paths: str) -> Column:
    """Whether each field is absent, null or a counter; a wrong one spoils its record."""
    return reduce(lambda a, b: a & b, [kind(v, p).isNull() | (kind(v, p) == "VOID") | counter(v, p).isNotNull() for p in paths])


def numbers(v: Column, *paths: str) -> Column:
    """The fields as an array: a counter's value, null where it is absent or null, and -1 where it is something
    else. As the body of a lambda many fields stay out of generated code, whose size is bounded."""
    whole = lambda x: F.when(x.isNull(), None).when(F.schema_of_variant(x) == "VOID", None).when(F.schema_of_variant(x) == "BIGINT", F.greatest(F.try_variant_get(x, "$", "bigint"), F.lit(-1))).otherwise(-1)
    return F.transform(F.array(*[part(v, p) for p in paths]), whole)


def bounded(v: Column, path: str, longest: int = 512) -> Column:
    """A JSON string that isn't blank, has no control characters and at most so many characters."""
    text = F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    return F.when((F.length(text) <= longest) & text.rlike(PROPER), text)


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO-8601 time with an explicit zone."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(text)))


def unix_ms(number: Column) -> Column:
    """Milliseconds of a unix time in seconds or milliseconds; from 10^11 on it is the latter."""
    return F.when(number >= 100_000_000_000, number).when(number >= 0, number * 1000)


def uuid7_ms(text: Column) -> Column:
    """The time in a version-7 uuid."""
    valid = F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(valid, F.conv(F.concat(F.substring(text, 1, 8), F.substring(text, 10, 4)), 16, 10).cast("bigint"))


def checked_sum(*values: Column) -> Column:
    """Null if the sum leaves 64 bits."""
    return reduce(F.try_add, values)


def saturating_delta(now: Column, before: Column) -> Column:
    """What was added since ``before`` (null is 0), at least 0."""
    return F.when(now.isNotNull(), F.greatest(now - F.coalesce(before, F.lit(0)), F.lit(0)))


def preview(text: Column, longest: int = PREVIEW) -> Column:
    """Blanks, control and format characters collapsed to single spaces, cut to
    so many code points; null if nothing is left."""
    clean = F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{Cc}\p{Cf}]+", " "))
    return F.nullif(F.rtrim(F.substring(clean, 1, longest)), F.lit(""))


def content_text(v: Column, path: str) -> Column:
    """The text of a prompt: a string, or the texts and media marks of its blocks."""
    blocks = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(blocks_text(blocks))


def blocks_text(blocks: Column) -> Column:
    """The texts and media marks of a prompt's blocks."""
    shown = F.transform(blocks, lambda b: F.when(bounded(b, "$.type", 64) == "text", F.when(kind(b, "$.text") == "STRING", F.try_variant_get(b, "$.text", "string"))).when(bounded(b, "$.type", 64) == "image", IMAGE).when(bounded(b, "$.type", 64) == "audio", AUDIO))
    return F.array_join(F.filter(shown, lambda x: x.rlike(r"\S")), " ")


def without_reminder(text: Column) -> tuple[Column, Column]:
    """Prompt text without one leading system reminder, and whether nothing but the
    reminder was there, which makes it an internal continuation."""
    pattern = r"(?is)^\s*<system-reminder(?=[>\s]).*?</system-reminder>"
    rest = F.regexp_replace(text, pattern, "")
    return F.trim(rest), text.rlike(pattern) & ~rest.rlike(r"\S")
