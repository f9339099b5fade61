"""The operators of this subpackage as queries over the driver's tables, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    bpe, exact_search, graph_search, html_text, license_scan, line_dedup, packing, quality_model, quality_rules, repeat_runs, secret_scan, simhash,
    spelling_variants,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), tokenizer("byte_bpe_50k.tiktoken"), digests=True)


def _license_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    alike = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in license_scan.SPELLINGS) + "}"
    dropped = ", ".join(map(quoted, license_scan.DROPPED))
    words = f"list_transform(regexp_split_to_array(lower(line), '{license_scan.NOT_WORD}'), lambda w: coalesce({alike}[w], w))"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in license_scan.all_known())
    return f"""
WITH texts AS (SELECT 'known' AS kind, row_number() OVER () AS r, license, t AS text FROM (VALUES {values}) v(license, t)
  UNION ALL SELECT 'doc', row_number() OVER (), NULL, text FROM documents),
lines AS (SELECT kind, r, license, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM texts),
plain AS (SELECT *, regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS worded, array_to_string({words}, '') AS t FROM lines),
canon AS (SELECT kind, r, license, line_no, worded, CASE WHEN regexp_matches(lower(line), '{license_scan.COPYRIGHT_LINE}') OR t IN ({dropped}) THEN '' ELSE t END AS t FROM plain),
parted AS (SELECT *, count(*) FILTER (NOT worded) OVER (PARTITION BY kind, r ORDER BY line_no) AS part FROM canon),
parts AS (SELECT kind, r, any_value(license) AS license, part, string_agg(t, '' ORDER BY line_no) AS t FROM parted WHERE worded AND t <> '' GROUP BY kind, r, part),
listed AS (SELECT kind, r, any_value(license) AS license, list(t ORDER BY part) AS p FROM parts GROUP BY kind, r),
known AS (SELECT DISTINCT license, array_to_string(p, '') AS t, len(p) AS n FROM listed WHERE kind = 'known'),
sizes AS (SELECT DISTINCT n FROM known),
runs AS (SELECT r, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM listed JOIN sizes ON len(p) > n WHERE kind = 'doc'),
found AS (SELECT r, 0 AS u, 0 AS place, k.license FROM listed l JOIN known k ON k.t = array_to_string(p, '') WHERE kind = 'doc'
  UNION ALL SELECT c.r, 1, c.line_no, k.license FROM canon c JOIN known k USING (t) WHERE kind = 'doc' AND worded
  UNION ALL SELECT runs.r, 2, i, k.license FROM runs JOIN known k ON k.t = array_to_string(p[i:i + runs.n - 1], '')),
named AS (SELECT r, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (u = 0), '') AS w, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (u = 1), '') AS l,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (u = 2), '') AS p, count(DISTINCT place) FILTER (u = 1) AS n FROM found GROUP BY r)
SELECT doc_id, coalesce(w, '') AS whole_license, coalesce(l, '') AS line_licenses, coalesce(p, '') AS part_licenses, coalesce(n, 0) AS n_lines_matched
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN named USING (r)"""


@query("op4_license_scan", _license_sql())
def licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(table(spark, d, "documents"))


@query("op5_line_dedup", rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
texts AS (SELECT DISTINCT source, text FROM docs WHERE source IS NOT NULL AND text IS NOT NULL),
pages AS (SELECT source, count(*) AS pages FROM texts GROUP BY source),
found AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM texts),
counted AS (SELECT source, line, count(*) AS n FROM found WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
gone AS (SELECT source, line FROM counted JOIN pages USING (source) WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * CAST({line_dedup.RATIO} AS DOUBLE)),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs),
marked AS (SELECT l.*, g.line IS NOT NULL AS drop FROM lines l LEFT JOIN gone g ON l.source = g.source AND l.line = g.line),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT drop) AS left_over, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped FROM marked GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_over, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM docs LEFT JOIN kept USING (r)
""")
def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=True).drop("source")


@query("op2_best_fit_packing")
def packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json")))


@query("op7_simhash_near_dedup")
def near_copies(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_copies(table(spark, d, "documents"))


@query("op1_secret_scan")
def secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "model")

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"), number("model"))


@query("op8_quality_rules")
def quality(spark: SparkSession, d: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, d, "documents"), tokenizer("piece_bpe_32k.model"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_tokens", *quality_rules.MEASURES)


@query("op6_graph_search")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return graph_search.search(graph_search.index(vectors), vectors.where("vec_id % 20 = 0"))


@query("op9_quality_model")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, d, "labels")))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@query("op10_html_extraction")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op11_spelling_variants", r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS tab),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END)) AS b FROM counted),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc_table),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
gaps AS (SELECT DISTINCT word, i, length(word) AS size, substr(word, 1, i) || substr(word, i + 2) AS gap FROM places),
longer AS (SELECT DISTINCT g.word, w.word AS near FROM gaps g JOIN words w ON w.word = g.gap),
pairs AS (SELECT DISTINCT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT word, near FROM longer UNION SELECT near, word FROM longer),
ranked AS (SELECT p.word, p.near, f.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, p.near) AS rank
  FROM pairs p JOIN words f ON f.word = p.near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND rank = 1),
chains AS (WITH RECURSIVE chain AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.onward)
  SELECT word, root FROM chain WHERE onward IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word)
""")
def spellings(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants.variants(table(spark, d, "documents"), damage=97)


@query("op12_exact_search", """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
""")
def highest_products(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return exact_search.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return repeat_runs.summary(repeat_runs.find_runs(table(spark, d, "documents"), plant=True))
