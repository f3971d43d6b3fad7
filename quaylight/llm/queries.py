"""The operators over whole tables, as queries (spark, folder of tables) -> DataFrame, and their SQL where there is some."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import bpe, divergence, kneser_ney, linededup, mih, packing, partenum, phrases, pivot, rules, tokenstore, toxicity, warc
from quaylight.llm.common import small_batches

#: The tokenizer file; QUAYLIGHT_TOKENIZER names another.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    if path := os.environ.get("QUAYLIGHT_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), tokenizer_path())


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_passages", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, folder, "labels"))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mih(spark: SparkSession, folder: str) -> DataFrame:
    return mih.nearest(table(spark, folder, "embeddings"))


def op7_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return pivot.top_products(table(spark, folder, "embeddings"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.classify(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels"))


def op9_partenum(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.similar_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokenstore.store_round_trip(spark, table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents"))


def op13_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents").select("doc_id", "text")).drop("failed_rule")


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_packing, op4_passages, op4_line_dedup, op5_toxicity, op6_mih, op7_pivot, op8_quality, op9_partenum, op10_tokens, op11_phrases, op12_divergence, op13_rules)}

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages
        ), q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > lead THEN lead END AS refers_to
        FROM q""",
    "op4_line_dedup": f"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
                 len(string_split(text, chr(10))) AS n
          FROM documents WHERE text IS NOT NULL
        ), hashed AS (
          SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines
        ), rolled AS (
          SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {linededup.BASE}) % {linededup.DIVISOR} = 0 OR i = n - 1 AS is_end FROM hashed
        ), numbered AS (
          SELECT *, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled
        ), chunks AS (
          SELECT doc_id, c, min(i) AS first, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, c
        ), ranked AS (
          SELECT *, CASE WHEN big AND row_number() OVER (PARTITION BY big, chunk ORDER BY doc_id, first) > 1 THEN 1 ELSE 0 END AS gone
          FROM (SELECT *, m >= {linededup.LEAST_LINES} OR len(regexp_extract_all(chunk, '[^ \\t\\n\\r]+')) >= {linededup.LEAST_WORDS} AS big FROM chunks)
        ), kept AS (
          SELECT doc_id, CAST(sum(m) AS BIGINT) AS n_lines, CAST(sum(m * gone) AS BIGINT) AS removed_lines, CAST(sum(gone) AS BIGINT) AS removed_chunks,
                 coalesce(string_agg(chunk, chr(10) ORDER BY first) FILTER (WHERE gone = 0), '') AS text
          FROM ranked GROUP BY doc_id
        )
        SELECT doc_id, n_lines, removed_lines, removed_chunks, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept""",
    "op7_pivot": """
        WITH v AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
          SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
          FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_partenum": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words
        ), shingles AS (SELECT doc_id, len(s) AS n, md5_number_lower(unnest(s)) AS h FROM sets
        ), links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id
        FROM sets s LEFT JOIN least l ON l.x = s.doc_id""",
    "op11_phrases": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
        ), runs AS (
          SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS phrase
          FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
        ), counts AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 30
        ), cuts AS (
          SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m >= 2
        ), scored AS (
          SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
          FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
          JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k+1:c.m], ' ')
        ), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
          SELECT lang, f, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i+s-1], ' '))) AS phrase
          FROM counts, (SELECT unnest([2, 3]) AS s) WHERE m > s
        ), longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase
        ), ranked AS (
          SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
          FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.f IS NULL OR 100 * g.f < 80 * a
        )
        SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), occ AS (SELECT d, lang, source, unnest(w) AS term FROM docs
        ), kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10
        ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), counts AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), groups AS (
          SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT AS n
          FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) s USING (lang, source)
        ), shares AS (
          SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) AS p
          FROM groups g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), whole AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term
        ), overall AS (
          SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.c + 2)) // (t.n + 2 * v.v) AS q
          FROM whole w JOIN v USING (lang) JOIN (SELECT lang, sum(c)::HUGEINT AS n FROM whole GROUP BY lang) t USING (lang)
        ), pairs AS (
          SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
          ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), terms AS (
          SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares s JOIN overall o ON o.lang = s.lang AND o.term = s.term WHERE s.c > 0 AND p > q
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank
          FROM (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms)
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_rules": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), lines AS (
          SELECT d, unnest(string_split(text, chr(10))) AS line FROM docs
        ), line_counts AS (
          SELECT d, count(*) AS lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE line LIKE '%...') AS broken
          FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY d
        ), windows AS (
          SELECT d, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS x FROM docs WHERE len(w) >= 3
        ), often AS (SELECT d, i FROM windows QUALIFY count(*) OVER (PARTITION BY d, x) > 1
        ), repeats AS (SELECT d, count(*) AS n FROM (SELECT DISTINCT d, i + k AS at FROM often, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY d
        ), most AS (SELECT d, max(n) AS n FROM (SELECT d, x, count(*) AS n FROM (SELECT d, unnest(w) AS x FROM docs) GROUP BY d, x) GROUP BY d
        ), figures AS (
          SELECT doc_id, text, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                 coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lines, 0) AS lines, coalesce(broken, 0) AS broken, coalesce(m.n, 0) AS most,
                 len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS lettered,
                 len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[a-z]')) AS lower, len(regexp_extract_all(text, '!')) AS calls
          FROM docs LEFT JOIN line_counts USING (d) LEFT JOIN repeats r USING (d) LEFT JOIN most m USING (d)
        ), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > 15 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * lines OR 100 * lettered < 70 * n_words
                    OR upper > lower OR 100 * calls > 30 * n_words OR 100 * broken > 40 * lines OR 100 * most > 30 * n_words) AS kept
        FROM judged""",
}
