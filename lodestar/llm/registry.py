"""Queries of the corpus operators over whole tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, prepare, table, text_or_empty
from lodestar.llm.decontam import contamination
from lodestar.llm.html_text import extract_main_text
from lodestar.llm.line_dedup import line_components
from lodestar.llm.lm_scoring import score_documents
from lodestar.llm.mixing import MixTarget, mix_sources
from lodestar.llm.ngram_join import ngram_components
from lodestar.llm.quality import classify_quality
from lodestar.llm.sharding import shard_rows
from lodestar.llm.spotsigs import edit_checks
from lodestar.llm.sweep import open_sales, sweep
from lodestar.llm.toxicity import score_toxicity
from lodestar.llm.url_list import build_list, judge_urls, mostly_blocked
from lodestar.llm.whitening import whiten

SHARDS, SHARD_SEED = 8, 7


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff trigram score of every document under all the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"),
        "found_0", "found_1", "found_2", "found_3",
    )


OP1_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS l
  FROM documents
), words AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM tokens
), placed AS (
  SELECT *, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT *,
    (SELECT count(*) FROM words) - count(*) OVER (PARTITION BY doc_id) AS others,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) END AS c2,
    CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) END AS c3
  FROM placed
), context AS (
  SELECT *, lag(c1) OVER d AS k1, lag(c2) OVER d AS k2 FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), scored AS (
  SELECT doc_id,
    CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level,
    CASE WHEN c3 > 0 THEN ln(c3 / k2)
         WHEN c2 > 0 THEN ln(c2 / k1) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
         ELSE CASE WHEN c1 > 0 THEN ln(c1 / others) ELSE ln(0.4 / (others + 1.0)) END
              + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
    END AS s
  FROM context
), summed AS (
  SELECT doc_id, count(*) AS n, sum(s) AS total, count(*) FILTER (WHERE level = 0) AS f0, count(*) FILTER (WHERE level = 1) AS f1,
    count(*) FILTER (WHERE level = 2) AS f2, count(*) FILTER (WHERE level = 3) AS f3
  FROM scored GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0)::bigint AS n_words, round(coalesce(total, 0.0), 4) AS log_score, round(total / n, 6) AS mean_log_score,
  coalesce(f0, 0)::bigint AS found_0, coalesce(f1, 0)::bigint AS found_1, coalesce(f2, 0)::bigint AS found_2, coalesce(f3, 0)::bigint AS found_3
FROM tokens t LEFT JOIN summed USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, and the line that stands for its component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_components(docs, Scratch(spark))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0-7, by the ``rows`` law."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("__hash")]
    rows = shard_rows(docs, order, SHARDS, SHARD_SEED, Scratch(spark), "op3")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that no source is repeated more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, Scratch(spark), MixTarget(max_repetition=2.0))
    return mixed.select(
        "doc_id", "source", "mix_epoch", "mix_tokens", "mix_weight", "mix_exponent", "mix_block", "mix_key"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, verbatim or edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-signature fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_checks(docs, Scratch(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from weak labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs).select("doc_id", "quality_votes", "quality_score", "quality_keep")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents linked by 5-word shingle Jaccard >= 0.75."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_components(docs, Scratch(spark)).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS l
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE []::varchar[] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reached JOIN edges ON r = a
)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, "html", "main").select(
        "page_id", "url", F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"),
        F.col("main.n_kept").alias("n_kept"), F.col("main.n_blocks").alias("n_blocks"),
        F.col("main.n_by_density").alias("n_by_density"),
    )


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules; where none fits, by the list of mostly blocked hosts."""
    scratch = Scratch(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = build_list(spark.createDataFrame(URL_RULES, "key string, verdict string"), scratch)
    listed = build_list(mostly_blocked(judge_urls(pages, "url", rules)), scratch)
    return judge_urls(pages, "url", rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH urls AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), ruled AS (
  SELECT urls.*, rule, verdict FROM urls LEFT JOIN fitting USING (r)
), bad AS (
  SELECT host AS b FROM ruled WHERE rule IS NOT NULL GROUP BY host HAVING 2 * count(*) FILTER (WHERE verdict = 'block') > count(*)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE host = b OR ends_with(host, '.' || b)) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight whitened components of all vectors."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark))


def op13_peak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales and their money by nation and moment."""
    scratch = Scratch(spark)
    sales, lines, clients = (table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients"))
    return sweep(open_sales(sales, lines, clients, scratch), scratch)


OP13_SQL = r"""
WITH ends AS (
  SELECT sale_id, floor(epoch_us(min(shipped_at)) / 1000000)::bigint + 86400 AS b FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), places AS (
  SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY client_id
), open AS (
  SELECT coalesce(nation, -1) AS nation, floor(epoch_us(sold_at) / 1000000)::bigint AS a, b, coalesce(floor(100 * total + 0.5), 0)::bigint AS cents
  FROM sales LEFT JOIN ends USING (sale_id) LEFT JOIN places USING (client_id) WHERE sold_at IS NOT NULL
), kept AS (
  SELECT * FROM open WHERE b IS NULL OR b > a
), twice AS (
  SELECT * FROM kept UNION ALL SELECT -2, a, b, cents FROM kept
), changes AS (
  SELECT nation, a AS t, 1 AS n, cents AS c FROM twice UNION ALL SELECT nation, b, -1, -cents FROM twice WHERE b IS NOT NULL
), moments AS (
  SELECT nation, t, sum(n) AS n, sum(c) AS c FROM changes GROUP BY nation, t HAVING sum(n) <> 0 OR sum(c) <> 0
), running AS (
  SELECT nation, t, lead(t) OVER w AS u, sum(n) OVER w AS n, sum(c) OVER w AS c FROM moments WINDOW w AS (PARTITION BY nation ORDER BY t)
)
SELECT nation::int AS nation_id, t AS from_s, u AS to_s, n::bigint AS n_open, c::bigint AS open_cents,
  (max(n) OVER (PARTITION BY nation ORDER BY t))::bigint AS high_open, c = max(c) OVER (PARTITION BY nation) AS is_peak
FROM running
"""


def _prepared(f):
    return lambda spark, sf_dir: f(prepare(spark), sf_dir)


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_line_dedup": op2_line_dedup, "op3_sharding": op3_sharding, "op4_mixing": op4_mixing, "op5_toxicity": op5_toxicity, "op6_ngram_join": op6_ngram_join, "op7_html_text": op7_html_text, "op8_decontamination": op8_decontamination, "op9_fingerprints": op9_fingerprints, "op10_quality": op10_quality, "op11_url_filters": op11_url_filters, "op12_whitening": op12_whitening, "op13_peak_sweep": op13_peak_sweep}
QUERIES = {name: _prepared(f) for name, f in QUERIES.items()}
ORACLES: dict[str, str] = {"op1_lm_scoring": OP1_SQL, "op6_ngram_join": OP6_SQL, "op11_url_filters": OP11_SQL, "op13_peak_sweep": OP13_SQL}
