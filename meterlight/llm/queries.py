"""The queries of this subpackage by name, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm import codes, decontam, images, kneserney, linededup, neardup, ngramjoin, packing, pivots, pseudolikelihood, scratch, secrets, sharding, urlfilter

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the url query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.col(decontam.FOUND).alias("f"))
    return found.select(
        "doc_id", "f.n_words", "f.n_hit", F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = """
WITH dw AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) i FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') grams
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
own AS (SELECT doc_id, i, n, grams FROM (SELECT doc_id, i, n, count(*) OVER w AS c, string_agg(word, ' ') OVER w AS grams FROM dw CROSS JOIN lens
  WINDOW w AS (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10 AND c = 10
  UNION ALL SELECT doc_id, a.i, l.n, array_to_string(a.rest[1:l.n], ' ') FROM (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) rest FROM dw WHERE EXISTS (SELECT 1 FROM lens WHERE n < 10)) a, lens l WHERE l.n < 10 AND len(a.rest) >= l.n),
occ AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM own o JOIN win USING (n, grams)),
hit AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM occ) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudolikelihood.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "log_probability", (F.col("log_probability") / F.nullif("n_words", F.lit(0))).alias("mean_log_probability"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("__dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP3_SQL = """
WITH l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 pos FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, pos, line, string_split(regexp_replace(trim(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', chr(1), 'g'), ' ') w FROM l),
k AS (SELECT doc_id, pos, unnest(CASE WHEN NOT regexp_matches(s, '[^\\x01 ]') THEN [] WHEN n < 8 THEN ['w' || s] ELSE ['w' || s,
   '0:' || n || ':' || lead || ':' || array_to_string(w[c1 + 1:], ' '),
   '1:' || n || ':' || lead || ':' || array_to_string(w[1:c1], ' ') || chr(2) || array_to_string(w[c2 + 1:], ' '),
   '2:' || n || ':' || lead || ':' || array_to_string(w[1:c2], ' ') || chr(2) || array_to_string(w[c3 + 1:], ' '),
   '3:' || n || ':' || lead || ':' || array_to_string(w[1:c3], ' ')] END) tpl
  FROM (SELECT *, len(w) n, array_to_string(w, ' ') s, array_to_string(w[1:2], ' ') lead, len(w) // 4 c1, len(w) * 2 // 4 c2, len(w) * 3 // 4 c3 FROM t)),
f AS (SELECT tpl, min(doc_id * 1000000 + pos) first FROM k GROUP BY tpl HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, pos FROM k JOIN f USING (tpl) WHERE doc_id * 1000000 + pos <> first),
g AS (SELECT doc_id, count(*) n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) dropped FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, count(*) FILTER (gone.pos IS NULL) n_kept, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) x, count(*) n FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(kept.n, 0) AS n_lines, coalesce(g.n, 0) AS n_dropped, coalesce(dropped, '') AS dropped, sha256(coalesce(x, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = """
WITH p AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
own AS (SELECT DISTINCT host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict FROM (SELECT DISTINCT host, path FROM p) q
  JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY host, path),
link AS (SELECT DISTINCT u src, l dst FROM (SELECT regexp_replace(url, '#.*', '') u, unnest([regexp_extract(html, '(?i)<link rel="canonical" href="([^"]*://[^"#]*)', 1), regexp_extract(html, '(?i)<meta http-equiv="refresh" content="[0-9]+; *url=([^"]*://[^"#]*)', 1)]) l FROM p) WHERE l <> '' AND u <> l),
two AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link),
reach AS (WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM two UNION SELECT r.src, b.dst FROM r JOIN two b ON r.dst = b.src) SELECT * FROM r),
said AS (SELECT src u, max(CASE verdict WHEN 'allow' THEN 1 ELSE 0 END) a FROM reach JOIN (SELECT DISTINCT regexp_replace(url, '#.*', '') dst, verdict FROM p JOIN own USING (host, path)) USING (dst) GROUP BY src)
SELECT page_id, p.host, p.path, own.rule, coalesce(own.verdict, CASE a WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own USING (host, path) LEFT JOIN said ON said.u = regexp_replace(p.url, '#.*', '')
"""


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups_of(table(spark, sf_dir, "documents"), length=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP7_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
c AS (SELECT w, min(doc_id) id FROM w GROUP BY w),
s AS (SELECT DISTINCT id, hash(array_to_string(w[i:i + 3], ' ')) g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) i FROM c WHERE len(w) > 0)),
n AS (SELECT id, count(*) n FROM s GROUP BY id),
e AS (SELECT a, b FROM (SELECT x.id a, y.id b, count(*) k FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id) JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a) SELECT * FROM r),
low AS (SELECT a id, min(b) b FROM reach GROUP BY a),
out AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE least(c.id, coalesce(low.b, c.id)) END AS component_id
  FROM w JOIN c ON c.w = w.w LEFT JOIN n ON n.id = c.id LEFT JOIN low ON low.id = c.id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM out
"""


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no images: each vector is drawn as one."""
    out = images.copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), render=images.vector_images, id_col="vec_id")
    return out.select("vec_id", "descriptors", F.col("component").alias("component_id"), F.col("same").alias("equal_images"), (F.col("vec_id") == F.col("component")).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = kneserney.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.col("__words").alias("n_words"), F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__kept").alias("kept"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivots.mine(table(spark, sf_dir, "embeddings").select("vec_id", turned.alias("label"), "embedding"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    listed = ",".join(str(x) for book in books for x in book.ravel())
    sums = scratch.save(coded.groupBy("label").agg(F.sum("__error").alias("label_error")), "label_errors").withColumnRenamed("label", "same_label")
    out = coded.join(scratch.Near(sums)(sums), F.col("label").eqNullSafe(F.col("same_label")))
    return out.select("vec_id", F.col("__code").alias("code"), F.col("__error").alias("error"), "label_error", F.sha2(F.lit(listed.encode()), 256).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Each round is a step: distances of all vectors to all entries, part by part."""
    nearest = """n{r} AS MATERIALIZED (SELECT vec_id, part, x, min(CAST(list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c) AS BIGINT) * 256 + entry) best
  FROM v JOIN b{r} USING (part) GROUP BY vec_id, part, x)"""
    moved = """b{s} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS c FROM
  (SELECT part, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS mean FROM n{r}, range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""
    steps = ",\n".join(f"{nearest.format(r=r)},\n{moved.format(r=r, s=r + 1)}" for r in range(4))
    return f"""
WITH k AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] q FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT vec_id, part, q[16 * part + 1:16 * part + 16] AS x FROM k, range(4) t(part)),
b0 AS (SELECT part, CAST(entry AS BIGINT) AS entry, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) USING (vec_id)),
{steps},
{nearest.format(r=4)},
e AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM n4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) for y in c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (vec_id), h
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramjoin.groups_of(table(spark, sf_dir, "documents"), length=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP13_SQL = OP7_SQL.replace("80 *", "85 *").replace(", doc_id = component_id AS kept", "")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_decontamination, op2_lm_scoring, op3_line_dedup, op4_url_filter, op5_secret_scan, op6_kd_sharding, op7_near_duplicates, op8_image_copies, op9_quality, op10_packing, op11_hard_negatives, op12_vector_codes, op13_ngram_join)
    }


def oracle_sql() -> dict[str, str]:
    """Operators that train, test randomness, cut windows of tokens or split trees have no SQL."""
    return {"op1_decontamination": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_near_duplicates": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_ngram_join": OP13_SQL}
