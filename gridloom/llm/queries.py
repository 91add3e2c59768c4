"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import blocknames, bytebpe, decontam, jaccard, langmix, lexical, linerepeats, minhash, pseudonyms, subword, urltree, warc, whitening
from gridloom.llm.jaccard import JaccardSettings
from gridloom.llm.minhash import MinHashSettings
from gridloom.llm.urltree import Rule
from gridloom.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

#: The key of a production run comes from its owner; pseudonyms of different keys can't be linked.
PII_KEY = "example-key"

URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


@query("op1_url_filters")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword.quality_scores(docs, subword.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"), RANKS)


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), JaccardSettings(words=3, percent=90))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), hashed AS (
  SELECT doc_id, pos, substr(sha256(trim(line, ' ')), 1, 32) AS h,
         length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS w FROM lines
), placed AS (
  SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM hashed
), picked AS (
  SELECT DISTINCT doc_id, CAST(substr(p, 33) AS INTEGER) AS pos FROM (
    SELECT doc_id, min(h || lpad(CAST(pos AS VARCHAR), 10, '0')) OVER (PARTITION BY doc_id ORDER BY words_before
      RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS p FROM placed)
), prints AS (
  SELECT p.* FROM placed p JOIN picked USING (doc_id, pos)
), keyed AS (
  SELECT a.doc_id, a.pos, a.w, a.words_before, 'r' || string_agg(x.h, '' ORDER BY x.pos) AS key
  FROM prints a JOIN placed x ON x.doc_id = a.doc_id AND x.pos >= a.pos AND x.words_before < a.words_before + 10
  GROUP BY ALL HAVING sum(x.w) >= 10
  UNION ALL
  SELECT a.doc_id, a.pos, a.w, a.words_before, 'l' || string_agg(x.h, '' ORDER BY x.pos) AS key
  FROM prints a JOIN placed x ON x.doc_id = a.doc_id AND x.pos <= a.pos AND x.words_before + x.w > a.words_before + a.w - 10
  GROUP BY ALL HAVING sum(x.w) >= 10
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS k FROM keyed
), anchors AS (
  SELECT a.key, a.doc_id, a.pos, a.w, a.words_before, f.doc_id AS src, f.pos AS spos
  FROM ranked a JOIN ranked f ON a.key = f.key AND f.k = 1 AND a.k > 1
), beside AS (
  SELECT a.key, a.doc_id, a.pos, a.src, x.pos AS xpos, x.w, coalesce(y.h = x.h, false) AS ok
  FROM anchors a JOIN placed x ON x.doc_id = a.doc_id AND x.pos <> a.pos
    AND x.words_before + x.w > a.words_before - 20 AND x.words_before < a.words_before + a.w + 20
  LEFT JOIN placed y ON y.doc_id = a.src AND y.pos = a.spos + x.pos - a.pos
), bounded AS (
  SELECT *, min(CASE WHEN NOT ok AND xpos > pos THEN xpos END) OVER (PARTITION BY doc_id, pos, key) AS stop,
         max(CASE WHEN NOT ok AND xpos < pos THEN xpos END) OVER (PARTITION BY doc_id, pos, key) AS start
  FROM beside
), hits AS (
  SELECT doc_id, xpos, max(w) AS w, min(src) AS src FROM (
    SELECT doc_id, pos AS xpos, w, src FROM anchors UNION ALL
    SELECT doc_id, xpos, w, src FROM bounded WHERE ok AND ((xpos > pos AND xpos < coalesce(stop, xpos + 1))
      OR (xpos < pos AND xpos > coalesce(start, xpos - 1)))
  ) GROUP BY doc_id, xpos
), runs AS (
  SELECT *, xpos - row_number() OVER (PARTITION BY doc_id ORDER BY xpos) AS run FROM hits
), gone AS (
  SELECT * FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, run) AS words FROM runs) WHERE words >= 10
), facts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.xpos) AS n_deleted, CAST(coalesce(sum(g.w), 0) AS BIGINT) AS words_deleted,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.xpos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.xpos GROUP BY l.doc_id
), sources AS (
  SELECT doc_id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources
  FROM (SELECT DISTINCT doc_id, src FROM gone) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_deleted, words_deleted, coalesce(sources, '') AS sources, sha256(kept) AS kept_sha256
FROM facts LEFT JOIN sources USING (doc_id)
"""


@query("op7_line_dedup", LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The window of LINES_SQL.
    rows = linerepeats.delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=linerepeats.MIN_WORDS // 2)
    return rows.select(
        "row.doc_id",
        F.col("lines").alias("n_lines"),
        F.col("deleted").alias("n_deleted"),
        F.col("words").alias("words_deleted"),
        F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_pii_pseudonyms")
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return rows.select("row.doc_id", F.size("pii").alias("n_values"), "pii", "row.text")


@query("op11_minhash")
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), MinHashSettings(words=2, percent=80))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    rows = rows.select("row.vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "z"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        F.col("z.whitened").alias("whitened"),
        F.col("z.explained").alias("explained"),
        "identity_error",
    )


SEARCH_SQL = r"""
WITH tokens AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
items AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole
), impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS v
  FROM counts JOIN lengths USING (doc_id), whole
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * v) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_ranked_search", SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
