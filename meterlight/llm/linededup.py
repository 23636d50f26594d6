"""Line dedup by log templates.

Lines are parsed by a tree of fixed depth: number of tokens, then the first
tokens, with variable fields (tokens with a digit) as wildcards. In a leaf, lines
share a template if they agree in all tokens, or, where lines are long enough, in
all but one of four equal parts; the part that varies is generalised. Of a
template that recurs in more than one document the first line stays and all
later ones go.

Templates are told apart by 96 bits of hash. Their first lines and documents are
minima and maxima, which are summed up before shuffling, so a line that a third
of all documents share costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm import scratch

#: Leading tokens in the path to a leaf.
DEPTH = 2
#: Tokens from which a line is parsed at all, and from which a part may vary.
LEAST_TOKENS, LEAST_VARIED = 1, 8
PARTS = 4
LINE, BLANKS = r"\n", "\t\r\f\x0b"
UNCLEAN = r"[\t\r\f\x0B0-9]|  "
#: A token with a digit, from its start, without backtracking.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def tokens(line: Column) -> Column:
    """Tokens of a line as one string, fields replaced by a mark that no text token equals."""
    spaced = F.translate(line, BLANKS, " " * len(BLANKS))
    clean = F.trim(F.regexp_replace(spaced, " {2,}", " "))
    # One scan tells the lines that need none of this.
    return F.when(line.rlike(UNCLEAN), F.regexp_replace(clean, VARIABLE, "\x00")).otherwise(F.trim(line))


def template_key(masked: Column, n: Column, variant: Column) -> Column:
    """Key (a, b) of the template in which part ``variant`` of the line, from 1,
    is left out; variant 0 is the whole line."""
    start = F.when(variant == 0, n).otherwise(F.floor(n * (variant - 1) / F.lit(PARTS)).cast("int"))
    end = F.when(variant == 0, n).otherwise(F.floor(n * variant / F.lit(PARTS)).cast("int"))
    before = F.call_function("substring_index", masked, F.lit(" "), start)
    after = F.call_function("substring_index", masked, F.lit(" "), end - n)
    lead = F.substring_index(masked, " ", DEPTH)
    return F.struct(F.xxhash64(variant, n, lead, before, after).alias("a"), F.hash(variant, n, after, before, lead).alias("b"))


def dropped(docs: DataFrame, *, least_tokens: int = LEAST_TOKENS, least_varied: int = LEAST_VARIED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lines): the numbers, from 0, of the lines to drop of each document
    that has any; h is the hash of its text."""
    line = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(F.split(text_col, LINE)).alias("pos", "line"))
    line = line.select(F.struct("id", "h", "pos").alias("at"), tokens(F.col("line")).alias("masked"))
    spaces = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    line = line.select("at", "masked", (spaces + 1).alias("n"))
    # Lines of as many fields alone, as of tables of figures, would all be one template.
    bare = ~F.col("masked").rlike(r"[^\x00 ]")
    variants = F.when((F.col("n") < least_tokens) | bare, F.array().cast("array<int>")).when(F.col("n") < least_varied, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(PARTS + 1))))
    keyed = line.select("at", "masked", "n", F.explode(variants).alias("variant"))
    keyed = keyed.select("at", template_key(F.col("masked"), F.col("n"), F.col("variant")).alias("key")).select("at", "key.a", "key.b")
    doc = F.struct("at.id", "at.h")
    # The first line is in the least document, as lines are ordered by document.
    again = keyed.groupBy("a", "b").agg(F.min("at").alias("first"), F.max(doc).alias("most")).where("not (struct(first.id, first.h) <=> most)")
    later = keyed.join(again.select("a", "b", "first"), ["a", "b"]).where(~F.col("at").eqNullSafe(F.col("first")))
    return later.groupBy("at.id", "at.h").agg(F.array_sort(F.collect_set("at.pos")).alias("lines"))


def dedup_lines(docs: DataFrame, *, least_tokens: int = LEAST_TOKENS, least_varied: int = LEAST_VARIED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with texts without their dropped lines, and the columns __lines
    (lines before) and __dropped (numbers of the dropped ones, from 0).

    Lines end at line feeds. Tokens are parted by blanks; a token with a digit is
    a variable field. Lines with fewer than ``least_tokens`` tokens always stay (by
    default none), and so do blank ones and those of fields alone; a part may vary in
    lines of ``least_varied`` tokens or more. The first line of a template is the one with the least id, then text hash, then number;
    a template that recurs only within one document is left alone. Line feeds
    between the lines that stay are kept.

    A null text stays null, with no lines. Texts that lose all lines become empty.
    Rows equal in id and text count as one document and get the same lines. An
    empty table gives no rows. Columns named __lines or __dropped are replaced.
    """
    columns = docs.columns
    docs, id_col, text_col = scratch.renamed(docs, id_col, text_col)
    text = F.col(text_col)
    drops = dropped(docs, least_tokens=least_tokens, least_varied=least_varied, id_col=id_col, text_col=text_col).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("lines").alias("__dropped"))
    hashed = docs.withColumn("__own", F.xxhash64(text_col))
    joined = hashed.join(drops, hashed[id_col].eqNullSafe(drops["__id"]) & (hashed["__own"] == drops["__h"]), "left")
    lines = F.split(text, LINE)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("__dropped", i), x)), lambda x: x.isNotNull())
    out = joined.select(
        *[F.when(F.col("__dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("__lines"),
        F.coalesce("__dropped", F.array().cast("array<int>")).alias("__dropped"),
    )
    return scratch.restored(out, columns, "__lines", "__dropped")
