"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm.benchmark_decontamination import contaminated, decontaminate, items_digest
from prefloom.llm.best_fit_packing import pack
from prefloom.llm.jaccard_join import jaccard_classes
from prefloom.llm.lm_scoring import score
from prefloom.llm.nn_descent import near_duplicates
from prefloom.llm.quality_rules import FENCES, judge, sketches, with_metrics
from prefloom.llm.ranked_search import ranked
from prefloom.llm.secret_scans import scan
from prefloom.llm.substring_dedup import remove_seen
from prefloom.llm.suffix_array_dedup import remove_repeats
from prefloom.llm.token_alignment import alignment
from prefloom.llm.url_filters import HOST_RULES, PATTERN_RULES, filter_urls
from prefloom.llm.warc_revisits import TRACKING, resolve_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            TWINS[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fence_sql() -> str:
    rows = [f"('{m}', '{side}', {least})" for m, (side, least) in FENCES.items()]
    return "VALUES " + ", ".join(rows)


QUALITY_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM doc
), win AS (
  SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM cut WHERE len(w) >= 8)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i : w[i] = w[i - 1])) AS stutter
  FROM cut LEFT JOIN repeats USING (rid)
), metrics AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN 10000 * stutter // n_words ELSE 0 END AS stutter_ratio,
    CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS long_words,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS short_words
  FROM counts
), vals AS (
  UNPIVOT (SELECT rid, lang, source, base_failed, {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in FENCES)} FROM metrics)
  ON {", ".join(FENCES)} INTO NAME metric VALUE value
), buckets AS (
  SELECT rid, lang, source, metric, value, base_failed,
    (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS bucket FROM vals
), good AS (SELECT * FROM buckets WHERE NOT base_failed
), levels AS (
  SELECT 1 AS level, lang, source, metric, bucket, count(*) AS n FROM good GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, metric, bucket, count(*) FROM good GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, bucket, count(*) FROM good GROUP BY ALL
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), quartiles AS (
  SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1,
    min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM placed GROUP BY ALL
), fence AS (
  SELECT level, lang, source, metric, side, total,
    CASE WHEN side = 'above' THEN q3 + greatest(3 * (q3 - q1), least) ELSE q1 - greatest(3 * (q3 - q1), least) END AS fence
  FROM quartiles JOIN ({_fence_sql()}) f(metric, side, least) USING (metric)
), chosen AS (
  SELECT a.lang, a.source, a.metric, a.side, a.total,
    CASE WHEN a.total >= 100 THEN a.fence WHEN b.total >= 100 THEN b.fence ELSE c.fence END AS fence
  FROM fence a JOIN fence b ON b.level = 2 AND b.metric = a.metric AND b.lang IS NOT DISTINCT FROM a.lang
  JOIN fence c ON c.level = 3 AND c.metric = a.metric WHERE a.level = 1
), judged AS (
  SELECT rid, max(c.total) AS rows_behind, bool_and(CASE WHEN c.side = 'above' THEN value <= fence ELSE value >= fence END) AS inside
  FROM buckets v JOIN chosen c ON v.metric = c.metric AND v.lang IS NOT DISTINCT FROM c.lang AND v.source IS NOT DISTINCT FROM c.source
  GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(inside, FALSE) AS kept, CAST(rows_behind AS BIGINT) AS rows_behind
FROM metrics LEFT JOIN judged USING (rid)
"""


@query(QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    metrics = with_metrics(docs, keep_text=False)
    judged = judge(metrics, sketches(metrics))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rows_behind",
    )


@query(
    r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bench WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM win
), hits AS (
  SELECT d.rid, d.i, d.n, win.item_id
  FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)) d
  JOIN win ON win.s = d.s AND win.n = d.n
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def _rules_sql(rules, patterns: bool) -> str:
    if patterns:
        return "VALUES " + ", ".join(f"('{r.action}', '{r.pattern}')" for r in rules)
    return "VALUES " + ", ".join(f"('{r.name}', '{r.action}', '{r.host}', '{r.path}')" for r in rules)


@query(
    rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), parts AS (
  SELECT rid, page_id, low,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT rid, arg_max(rule, length(rhost) + length(rpath)) AS rule, arg_max(action, length(rhost) + length(rpath)) AS action
  FROM parts JOIN ({_rules_sql(HOST_RULES, False)}) r(rule, action, rhost, rpath)
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid
), found AS (
  SELECT rid, min(action) AS action FROM parts JOIN ({_rules_sql(PATTERN_RULES, True)}) p(action, pattern) ON regexp_matches(low, pattern)
  GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(f.action, p.action, 'allow') AS verdict
FROM parts LEFT JOIN fits f USING (rid) LEFT JOIN found p USING (rid)
"""
)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response, and a later revisit of its URL: some with a weak or a stale etag,
    some with a date only, some with nothing to check."""
    page = pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"))
    age = F.date_format(F.timestamp_seconds(F.col("page_id") * 60), "yyyy-MM-dd HH:mm:ss")
    kind = F.substring("digest", 1, 1)
    response = page.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"),
        "url",
        (2 * F.col("page_id")).alias("captured_at"),
        F.lit("response").alias("kind"),
        F.col("digest").alias("etag"),
        age.alias("last_modified"),
        "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("digest"), F.lit("Date"), age).alias("headers"),
    )
    none = F.lit(None).cast("string")
    revisit = page.select(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("record_id"),
        F.concat(F.regexp_replace("url", "^[a-z]+:", "http:"), F.lit("#again")).alias("url"),
        (2 * F.col("page_id") + 1001).alias("captured_at"),
        F.lit("revisit").alias("kind"),
        F.when(kind < "4", none).when(kind == "f", F.lit("stale")).otherwise(F.concat(F.lit("W/"), "digest")).alias("etag"),
        F.when((kind >= "1") & (kind < "4"), age).alias("last_modified"),
        none.alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), F.lit("later")
        ).alias("headers"),
    )
    return response.unionByName(revisit)


@query(
    rf"""
WITH page AS (
  SELECT page_id, md5(html) AS digest, strftime(make_timestamp(page_id * 60000000), '%Y-%m-%d %H:%M:%S') AS age,
    regexp_replace(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')), '#.*$', '') AS low FROM pages
), key AS (
  SELECT page_id, digest, age, substr(digest, 1, 1) AS kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '^(www|m)\.', ''),
    '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '(?:/|\.html)$', '') AS canonical_url FROM page
), revisit AS (
  SELECT 'v' || page_id AS record_id, canonical_url, 2 * page_id + 1001 AS captured_at,
    CASE WHEN kind < '4' THEN NULL WHEN kind = 'f' THEN 'stale' ELSE digest END AS etag,
    CASE WHEN kind >= '1' AND kind < '4' THEN age END AS last_modified FROM key
), response AS (
  SELECT 'r' || page_id AS response_id, canonical_url AS url, 2 * page_id AS response_at, digest, age FROM key
), found AS (
  SELECT * FROM revisit ASOF LEFT JOIN response ON canonical_url = url AND captured_at > response_at
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NULL AND last_modified IS NULL THEN 'no_validator'
    WHEN coalesce(etag <> digest, FALSE) OR coalesce(last_modified <> age, FALSE) THEN 'mismatch' ELSE 'resolved' END AS status FROM found
)
SELECT record_id, canonical_url, captured_at, status, response_id, response_at,
  CASE WHEN status = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN status = 'resolved' THEN 'Content-Type=text/html;ETag=' || digest || ';cache-control=max-age=60;date=later' END AS headers
FROM judged
"""
)
def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(fields, ";"))


@query()
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = scan(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "start", "end", F.round("probability", 6).alias("probability"), "is_secret")


@query()
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("spans")


@query(
    r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)
), seen AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM seen
), lists AS (SELECT rid, count(*) AS n, list(p) AS gone FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i : NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM doc LEFT JOIN lists USING (rid)
"""
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_seen(table(spark, sf_dir, "documents"), keep_text=False)


@query()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("is_first")


@query(
    r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), word AS (SELECT rid, i, w[i] AS w, w[i - 1] AS v, w[i - 2] AS u FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM doc)
), uni AS (SELECT w, count(*) AS n FROM word GROUP BY w
), uni_own AS (SELECT rid, w, count(*) AS n FROM word GROUP BY rid, w
), bi AS (SELECT v, w, count(*) AS n FROM word WHERE i > 1 GROUP BY v, w
), bi_own AS (SELECT rid, v, w, count(*) AS n FROM word WHERE i > 1 GROUP BY rid, v, w
), tri AS (SELECT u, v, w, count(*) AS n FROM word WHERE i > 2 GROUP BY u, v, w
), tri_own AS (SELECT rid, u, v, w, count(*) AS n FROM word WHERE i > 2 GROUP BY rid, u, v, w
), n AS (SELECT count(*) AS n FROM word
), c AS (
  SELECT word.rid, word.i, least(word.i - 1, 2) AS longest, n.n - len(doc.w) AS outside, u.n - uo.n AS uni,
    coalesce(b.n - bo.n, 0) AS bi, coalesce(t.n - tt.n, 0) AS tri, coalesce(cu.n - co.n, 0) AS before_one, coalesce(cb.n - cbo.n, 0) AS before_two
  FROM word JOIN n ON TRUE JOIN doc ON doc.rid = word.rid JOIN uni u ON u.w = word.w
  JOIN uni_own uo ON uo.rid = word.rid AND uo.w = word.w
  LEFT JOIN bi b ON word.i > 1 AND b.v = word.v AND b.w = word.w
  LEFT JOIN bi_own bo ON word.i > 1 AND bo.rid = word.rid AND bo.v = word.v AND bo.w = word.w
  LEFT JOIN tri t ON word.i > 2 AND t.u = word.u AND t.v = word.v AND t.w = word.w
  LEFT JOIN tri_own tt ON word.i > 2 AND tt.rid = word.rid AND tt.u = word.u AND tt.v = word.v AND tt.w = word.w
  LEFT JOIN uni cu ON word.i > 1 AND cu.w = word.v
  LEFT JOIN uni_own co ON word.i > 1 AND co.rid = word.rid AND co.w = word.v
  LEFT JOIN bi cb ON word.i > 2 AND cb.v = word.u AND cb.w = word.v
  LEFT JOIN bi_own cbo ON word.i > 2 AND cbo.rid = word.rid AND cbo.v = word.u AND cbo.w = word.v
), v AS (
  SELECT *, CASE WHEN tri > 0 THEN 2 WHEN bi > 0 THEN 1 ELSE 0 END AS used,
    CASE WHEN tri > 0 THEN tri / before_two WHEN bi > 0 THEN bi / before_one
      WHEN uni > 0 THEN uni / greatest(outside, 1) ELSE 1 / (outside + 1) END AS value FROM c
), s AS (
  SELECT rid, count(*) FILTER (used = longest AND (used > 0 OR uni > 0)) AS n_hits, count(*) FILTER (used = 0 AND uni = 0) AS n_unseen,
    CAST(sum(CAST(round((ln(value) + (longest - used) * ln(0.4)) * 1000000) AS BIGINT)) AS BIGINT) AS log_score
  FROM v GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hits, 0) AS n_hits, coalesce(n_unseen, 0) AS n_unseen, coalesce(log_score, 0) AS log_score
FROM doc LEFT JOIN s USING (rid)
"""
)
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM doc WHERE len(w) > 0
), item AS (
  SELECT row_number() OVER () AS no, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), asked AS (SELECT no, item_id, t, count(*) AS times FROM (SELECT no, item_id, unnest(w) AS t FROM item) GROUP BY ALL
), post AS (
  SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(size.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, size GROUP BY t
), hit AS (
  SELECT no, item_id, rid, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * post.n * size.n) // size.total)))) AS BIGINT) AS score
  FROM asked JOIN post USING (t) JOIN weight USING (t), size GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM hit WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query(
    r"""
WITH RECURSIVE vec AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS v FROM embeddings
), good AS (
  SELECT * FROM vec WHERE len(v) > 0 AND len(list_filter(v, lambda x : x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x : x <> 0)) > 0
), edge AS MATERIALIZED (
  SELECT a.rid AS u, b.rid AS w FROM good a JOIN good b ON a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT rid AS u, rid AS w FROM vec
  UNION SELECT reach.u, edge.w FROM reach JOIN edge ON edge.u = reach.w
), least AS (SELECT u, min(vec_id) AS component_id FROM reach JOIN vec ON vec.rid = reach.w GROUP BY u
), degree AS (SELECT u, count(*) AS n FROM edge GROUP BY u
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vec JOIN least ON least.u = rid LEFT JOIN degree ON degree.u = rid
"""
)
def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
