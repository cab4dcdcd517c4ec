"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.llm.decontaminate import PositionalIndex
from strokeflow.llm.html_text import extract_text
from strokeflow.llm.language import identify
from strokeflow.llm.licenses import scan_licenses
from strokeflow.llm.line_dedup import dedup_lines
from strokeflow.llm.media import media_features
from strokeflow.llm.mixing import mix_sources
from strokeflow.llm.near_dedup import near_duplicates
from strokeflow.llm.pieces import encode_texts
from strokeflow.llm.quality import score_documents
from strokeflow.llm.ranked_search import search
from strokeflow.llm.url_filter import Rule, filter_urls
from strokeflow.llm.variants import corpus_words, group_variants

RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
UNWANTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_DOMAINS = [f"{name}.example.{top}" for name in UNWANTED for top in ("com", "net", "org")]

#: Target shares of the mix: three parts for src0, then one or two parts in turn.
WEIGHTS = {f"src{i}": 3.0 if i == 0 else 1.0 + i % 2 for i in range(20)}
#: One part for each source that is not listed, and for documents without a source.
OTHER_WEIGHT = 1.0
MIX_SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(list(WEIGHTS.items()), "source string, weight double")
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, weights, seed=MIX_SEED, default=OTHER_WEIGHT).select("doc_id", "source", "copy", "mix_key", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in BLOCKED_DOMAINS], "key string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PositionalIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return index.report().select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


def op10_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PositionalIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("near_items", ",").cast("binary"), 256)
    return index.near_report().select(
        "doc_id", "n_words", "n_near", "n_near_items", digest.alias("near_items_sha256"), "best_share"
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(corpus_words(table(spark, sf_dir, "documents"), slip_in=31))


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "span_bytes",
    )


def queries() -> dict:
    each = (
        op1_media_columns, op2_html_text, op3_language_id, op4_mix_sources, op5_line_dedup, op6_near_dedup,
        op7_url_filter, op8_license_scan, op9_quality, op10_decontaminate,
        op10_near_passages, op11_ranked_search, op12_spelling_variants, op13_pieces,
    )
    return {f.__name__: f for f in each}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP4 = """
WITH RECURSIVE weights(source, weight) AS (VALUES {weights}),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
joined AS (SELECT s.source, s.n, coalesce(w.weight, 0.0) AS weight
           FROM sizes s LEFT JOIN weights w ON s.source = w.source),
rates AS (SELECT source, CAST(weight AS DOUBLE)
            * (CAST((SELECT sum(n) FROM joined) AS DOUBLE) / (SELECT sum(CAST(weight AS DOUBLE)) FROM joined)) / n AS rate
          FROM joined),
parts AS (SELECT source, greatest(CAST(ceil(rate / 16.0) AS INTEGER), 1) AS parts, rate FROM rates WHERE rate > 0),
cdf(source, j, mean, p, c) AS (
  SELECT source, 0, rate / parts, exp(-(rate / parts)), exp(-(rate / parts)) FROM parts
  UNION ALL
  SELECT source, j + 1, mean, p * mean / (j + 1), c + p * mean / (j + 1) FROM cdf WHERE j < 95),
tables AS (SELECT source, list(c ORDER BY j) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, d.text, part,
         len(list_filter(t.cdf, lambda c: c < (('0x' || substr(md5('7:' || d.doc_id || ':' || part), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0)) AS k
  FROM documents d JOIN parts p ON d.source = p.source JOIN tables t ON d.source = t.source,
       LATERAL (SELECT unnest(generate_series(1, p.parts)) AS part)),
copies AS (SELECT doc_id, source, text, part, unnest(generate_series(1, k)) AS c FROM drawn WHERE k > 0)
SELECT doc_id, source, CAST(c + (part - 1) * 96 AS INTEGER) AS "copy",
       md5('7/order:' || doc_id || ':' || part || ':' || c) AS mix_key, text
FROM copies
"""

_OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id < f.top AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP7 = """
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), {az}) AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {rules} END AS rule,
    list_has_any([array_to_string(string_split(host, '.')[i:], '.') FOR i IN generate_series(1, len(string_split(host, '.')))],
                 [{listed}]) AS listed
  FROM parsed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP10 = r"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
    array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.n, g.i, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.gram = x.gram),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM found) GROUP BY doc_id),
which AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN which USING (doc_id)
"""

_OP11 = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, row_number() OVER () AS row, w, CAST(len(w) AS BIGINT) AS n FROM terms WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {az}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
tfs AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
lengths AS (SELECT row, doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM docs, totals),
added AS (
  SELECT t.row, t.term, w.weight * ((1000000000 * t.tf) // (1000 * t.tf + 12 * l.m)) AS score
  FROM tfs t JOIN weights w USING (term) JOIN lengths l USING (row)),
scores AS (
  SELECT i.item_id, a.row, CAST(sum(a.score * i.times) AS BIGINT) AS score
  FROM wanted i JOIN added a USING (term) GROUP BY i.item_id, a.row),
ranked AS (
  SELECT s.item_id, l.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, l.doc_id) AS rank
  FROM scores s JOIN lengths l USING (row) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_OP12 = f"""
WITH RECURSIVE bits(i, j, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM (SELECT unnest(generate_series(0, 255)) AS i)
  UNION ALL
  SELECT i, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bits WHERE j < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE j = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
coded AS (SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM each),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(0, length(x) // 2 - 1),
      lambda i: CAST(strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 17 AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM coded, crc),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
shorter AS (SELECT DISTINCT word AS a, n AS a_n, substr(word, 1, i - 1) || substr(word, i + 1) AS b FROM places),
blanked AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS blank FROM places),
deleted AS (SELECT s.a, s.a_n, s.b, w.n AS b_n FROM shorter s JOIN words w ON s.b = w.word),
near AS (
  SELECT a AS word, b AS other, b_n AS other_n FROM deleted
  UNION ALL SELECT b, a, a_n FROM deleted
  UNION ALL SELECT x.word, y.word, y.n FROM blanked x JOIN blanked y ON x.blank = y.blank AND x.i = y.i AND x.word <> y.word),
tops AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(t.n_near, 0) AS n_near, CASE WHEN t.other_n >= 10 * w.n THEN t.other END AS form,
         CASE WHEN t.other_n >= 10 * w.n THEN t.other_n END AS form_n
  FROM words w LEFT JOIN tops t ON w.word = t.word AND t.place = 1),
paths(word, root) AS (
  SELECT word, form FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON p.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT p.word, p.root FROM paths p JOIN formed f ON p.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN last l ON f.word = l.word
"""


def _op7_sql() -> str:
    rules = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
    )
    allowed = ", ".join(f"'{r.text}'" for r in RULES if r.verdict == "allow")
    listed = ", ".join(f"'{x}'" for x in BLOCKED_DOMAINS)
    return _OP7.format(az=_AZ, rules=rules, allowed=allowed, listed=listed)


def oracle_sql() -> dict[str, str]:
    weights = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())
    return {
        "op4_mix_sources": _OP4.replace("{weights}", weights),
        "op5_line_dedup": _OP5,
        "op7_url_filter": _op7_sql(),
        "op10_decontaminate": _OP10.replace("{az}", _AZ),
        "op11_ranked_search": _OP11.replace("{az}", _AZ),
        "op12_spelling_variants": _OP12,
    }
