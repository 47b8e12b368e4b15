"""Retrieval over ``documents`` (title = source, tags = language, tables = source)
with the texts of ``benchmark`` as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.operators import retrieval as I
from workload.loading import document_entries
from workload.tables import table


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark texts; some name a source, some are blank or token-less."""
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    text = (F.when(i % 10 == 7, F.lit(" \n")).when(i % 10 == 8, F.lit("?!"))
            .when(i % 3 == 0, F.concat(F.lit("Src"), (i % 20).cast("string"), F.lit(" zzunseen "), "text"))
            .otherwise(F.col("text")))
    return b.select(i.alias("qid"), text.alias("query"))


def _index(spark: SparkSession, sf: str) -> I.Index:
    return I.build_index(document_entries(spark, sf))


def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    t = I.entry_terms(document_entries(spark, sf))
    return t.groupBy("ord").agg(F.count("*").alias("n_terms"), F.sum("c").alias("n_tokens"),
                                F.max("c").alias("max_count"))


def idf(spark: SparkSession, sf: str) -> DataFrame:
    terms, size = I.frequencies((I.build_segment(document_entries(spark, sf)),))
    return terms.select("tok", "df", I._idf(F.col("df"), size.scalar()).alias("idf"))


def norms(spark: SparkSession, sf: str) -> DataFrame:
    return I.lengths((I.build_segment(document_entries(spark, sf)),))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", "kind", "score")


def boosts(spark: SparkSession, sf: str) -> DataFrame:
    """The phrases in each query, their boost and how many entries get it."""
    return I.phrase_boosts(document_entries(spark, sf), _queries(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    r = _queries(spark, sf).withColumn("top_k", F.when(F.col("qid") % 4 > 0, F.col("qid") % 9).cast("int"))
    out = I.retrieve(_index(spark, sf), r)
    return out.select("qid", "error", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def extended(spark: SparkSession, sf: str) -> DataFrame:
    """Pages added behind the documents, then searched."""
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("page."), F.col("page_id").cast("string")).alias("id"),
        F.lit("relation").alias("kind"), F.lit("").alias("title"), F.col("html").alias("text"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("tables"),
        F.col("page_id").alias("ord"))
    return _shown(I.search(I.extend_index(_index(spark, sf), p), _queries(spark, sf), 5))


QUERIES = {
    "I1_term_index": term_frequencies,
    "I2_idf": idf,
    "I3_cosine_norms": norms,
    "I3_search": lambda s, d: _shown(I.search(_index(s, d), _queries(s, d), 3)),
    "I4_boosts": boosts,
    "I5_filtered_search": lambda s, d: _shown(I.search(
        _index(s, d), _queries(s, d), 3, kind="metric", tables=["src1", "src2", "src3"])),
    "I6_ranking": lambda s, d: _shown(I.search(_index(s, d), _queries(s, d), 20)),
    "I7_retrieve": requests,
    "I8_extended_search": extended,
}

_Q = r"""(SELECT item_id AS qid, CASE WHEN item_id % 10 = 7 THEN ' ' || chr(10) WHEN item_id % 10 = 8 THEN '?!'
  WHEN item_id % 3 = 0 THEN 'Src' || (item_id % 20) || ' zzunseen ' || text ELSE text END AS query FROM benchmark)"""
_DOCS = """(SELECT 'doc.' || doc_id AS id, CASE WHEN lang = 'en' THEN 'metric' ELSE 'table_note' END AS kind,
  source AS title, text, lang AS tag, source AS tbl, doc_id AS ord FROM documents)"""
_MORE = f"""(SELECT * FROM {_DOCS} UNION ALL SELECT 'page.' || page_id, 'relation', '', html, NULL, NULL,
  page_id - (SELECT min(page_id) FROM pages) + (SELECT max(doc_id) FROM documents) + 1 FROM pages)"""
_WORDS = r"regexp_extract_all(lower({x}), '[a-z_][a-z0-9_]*|\d+')"


def _tfidf(entries: str) -> str:
    body = "title || ' ' || text || ' ' || coalesce(tag, '')"
    return f"""
WITH e AS (SELECT * FROM {entries}), q AS (SELECT * FROM {_Q}),
tf AS (SELECT ord, tok, count(*) AS c FROM (SELECT ord, unnest({_WORDS.format(x=body)}) AS tok FROM e) GROUP BY 1, 2),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT greatest(count(*), 1) AS n FROM e),
idf AS (SELECT tok, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
norm AS (SELECT ord, sqrt(sum(((1 + ln(c)) * idf) ** 2)) AS norm FROM tf JOIN idf USING (tok) GROUP BY 1),
qtf AS (SELECT qid, tok, count(*) AS c FROM (SELECT qid, unnest({_WORDS.format(x='query')}) AS tok FROM q) GROUP BY 1, 2),
qv AS (SELECT qid, tok, (1 + ln(c)) * coalesce(idf, (SELECT ln(n + 1) + 1 FROM n)) AS w FROM qtf LEFT JOIN idf USING (tok)),
qn AS (SELECT qid, sqrt(sum(w * w)) AS qn FROM qv GROUP BY 1),
dot AS (SELECT qid, ord, sum((1 + ln(tf.c)) * idf * w) AS dot FROM tf JOIN idf USING (tok) JOIN qv USING (tok) GROUP BY 1, 2),
boost AS (SELECT qid, ord, (CASE WHEN contains(lower(query), lower(tag)) THEN 0.25::DOUBLE ELSE 0 END)
    + (CASE WHEN title <> '' AND contains(lower(query), lower(title)) THEN 0.35::DOUBLE ELSE 0 END) AS boost
  FROM e, q WHERE qid IN (SELECT qid FROM qtf)),
hits AS (SELECT boost.qid, boost.ord, id, kind, tbl, coalesce(dot, 0) / (qn * coalesce(norm, 1)) + boost AS score
  FROM boost JOIN e ON e.ord = boost.ord JOIN qn ON qn.qid = boost.qid
  LEFT JOIN norm ON norm.ord = boost.ord LEFT JOIN dot ON dot.qid = boost.qid AND dot.ord = boost.ord)"""


def _top(entries: str, k: int, where: str = "true") -> str:
    return f"""{_tfidf(entries)}
SELECT qid, rank, id, kind, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS rank FROM hits
  WHERE score > 0 AND {where}) WHERE rank <= {k}"""


ORACLES = {
    "I1_term_index": f"""{_tfidf(_DOCS)}
SELECT ord, count(*) AS n_terms, CAST(sum(c) AS BIGINT) AS n_tokens, max(c) AS max_count FROM tf GROUP BY 1""",
    "I2_idf": f"{_tfidf(_DOCS)} SELECT tok, df, idf FROM idf",
    "I3_cosine_norms": f"{_tfidf(_DOCS)} SELECT ord, coalesce(norm, 1) AS norm FROM e LEFT JOIN norm USING (ord)",
    "I3_search": _top(_DOCS, 3),
    "I4_boosts": f"""{_tfidf(_DOCS)},
phrase AS (SELECT lower(tag) AS phrase, 0.25::DOUBLE AS boost, count(*) AS owners FROM e GROUP BY 1
  UNION ALL SELECT lower(title), 0.35::DOUBLE, count(*) FROM e WHERE title <> '' GROUP BY 1)
SELECT qid, phrase, boost, owners FROM q, phrase WHERE contains(lower(query), phrase) AND qid IN (SELECT qid FROM qtf)""",
    "I5_filtered_search": _top(_DOCS, 3, "kind = 'metric' AND tbl IN ('src1', 'src2', 'src3')"),
    "I6_ranking": _top(_DOCS, 20),
    "I7_retrieve": f"""{_tfidf(_DOCS)},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ord) AS rank FROM hits WHERE score > 0),
a AS (SELECT qid, CASE WHEN trim(replace(query, chr(10), '')) = '' THEN 'empty_query' END AS error,
  greatest(1, least(5, coalesce(nullif(CASE WHEN qid % 4 > 0 THEN qid % 9 END, 0), 3))) AS k FROM q)
SELECT a.qid, error, rank, id, round(score, 4) AS score FROM a LEFT JOIN r ON a.qid = r.qid AND rank <= k""",
    "I8_extended_search": _top(_MORE, 5),
}
