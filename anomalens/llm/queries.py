"""One query per operator over its whole table, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.llm import (conversation_repair, exact_dedup, mixing, neighbours, ngram_join, packing, quality,
                           quality_rules, sharding, suffix_dedup, toxicity, warc, whitening)
from anomalens.llm.common import text_of, word_count
from anomalens.plans.storage import cut_lineage, scratch_path

# Sizes that the contracts fix.
REPEAT_BYTES, NEIGHBOURS, SHARDS, SEQUENCE = 50, 20, 16, 1024


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), REPEAT_BYTES)
    return found.select("doc_id", "n_bytes",
                        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    # Only word counts go on; they are written, since the mix reads them twice.
    narrow = cut_lineage(docs.select("doc_id", "source", word_count(text_of("text")).alias("words")))
    out = mixing.mix(narrow, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, NEIGHBOURS)


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    rows = _table(spark, folder, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"))
    return sharding.assign_shards(rows, "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(_table(spark, folder, "documents").select("doc_id", "text"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), tokenizer_path(), size=SEQUENCE)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive, files = scratch_path(spark, "archive"), scratch_path(spark, "warc")
    warc.write_archive(_table(spark, folder, "pages"), archive)
    warc.write_warc(spark, archive, files)
    records = warc.read_warc(spark, files)

    def page(name: str):
        return F.regexp_extract(name, "^<urn:page:(.*)>$", 1).try_cast("bigint")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page("refers_to").alias("refers_to"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality.train(docs, labels)
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, folder, "conversations"))
    return conversation_repair.repair(rows, copies="copies").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_toxicity, op3_source_mix, op4_nearest_neighbours, op5_sharding, op6_exact_dedup,
    op7_ngram_join, op8_best_fit_packing, op9_warc, op10_quality, op11_embedding_whitening, op12_quality_rules,
    op13_conversation_repair)}

def _quality_rules_sql() -> str:
    blank, stop = quality_rules._BLANK, ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    broken = " OR ".join(
        [f"100 * {r.count} < {r.least} * {r.of}" for r in quality_rules.RULES if r.least is not None]
        + [f"100 * {r.count} > {r.most} * {r.of}" for r in quality_rules.RULES if r.most is not None])
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
                  FROM (SELECT rid, regexp_extract_all(text, '[^{blank}]+') AS ws FROM t)),
        windows AS (SELECT rid, i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o) AS g, lead(w, 2) OVER o IS NOT NULL AS whole
                    FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
        hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows WHERE whole) WHERE n > 1),
        repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM hits, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
        per_word AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
                            count(*) FILTER (w IN ({stop})) AS n_stop_words FROM words GROUP BY rid),
        lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
        per_line AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                            count(*) FILTER (regexp_matches(line, '^[{blank}]*[-*•]')) AS n_bullet_lines,
                            count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[{blank}]*$')) AS n_open_lines
                     FROM lines WHERE regexp_matches(line, '[^{blank}]') GROUP BY rid),
        counts AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                          length(regexp_replace(text, '[^{quality_rules.SYMBOLS}]', '', 'g')) AS n_symbols,
                          length(regexp_replace(text, '[^{quality_rules.MARKS}]', '', 'g')) AS n_marks,
                          coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
                          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines,
                          coalesce(n_open_lines, 0) AS n_open_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
                   FROM t LEFT JOIN per_word USING (rid) LEFT JOIN per_line USING (rid) LEFT JOIN repeats USING (rid)),
        based AS (SELECT *, n_words < {quality_rules.LEAST_WORDS}
                         OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM counts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT ({broken}) AS kept FROM based"""


# The same DP over (row, state), with whole audits compared as texts.
_REPAIR_SQL = r"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                   lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crcs),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    coded AS (SELECT * EXCLUDE (key), xor(list_reduce(list_prepend(4294967295::BIGINT,
                         list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                         lambda a, b: xor(a >> 8, crcs[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS fault
              FROM keyed, crc_table),
    rows_ AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
              FROM coded, (VALUES (1), (2)) c(copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 16), left(text, 64),
                           sha256(strlen(role) || ':' || role || text), copy) AS i FROM rows_),
    judged AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS ending,
                      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
    faults AS (SELECT *, CASE WHEN ending = '' THEN 'b' WHEN seen THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END
                         AS fault FROM judged),
    stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    inserts(state, ins, mid) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
                                 (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
    edits(mid, edit, initial, after) AS (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2),
        (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (3, 'R', NULL, 2), (2, 'R', NULL, 3), (0, 'D', NULL, 0),
        (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)),
    dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best, 1 AS pick FROM stats
           UNION ALL
           SELECT * FROM (
               SELECT f.conv_id, f.i, e.after, {'cost': dp.best.cost + 5 * length(s.ins) + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                          + CASE WHEN fault = 't' AND e.edit <> 'D' THEN 5 ELSE 0 END, 'audit': dp.best.audit || s.ins || e.edit} AS b,
                      row_number() OVER (PARTITION BY f.conv_id, e.after ORDER BY b) AS p
               FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
               JOIN inserts s ON s.state = dp.state JOIN edits e ON e.mid = s.mid
               WHERE (e.initial IS NULL OR e.initial = f.initial) AND (f.fault NOT IN ('b', 'd') OR e.edit = 'D')) WHERE p = 1),
    ends AS (SELECT dp.conv_id, min({'cost': best.cost + 5 * length(ins), 'audit': best.audit || ins}) AS e
             FROM dp JOIN stats ON stats.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = stats.n
             JOIN inserts USING (state) WHERE mid IN (0, 3) GROUP BY dp.conv_id),
    letters AS (SELECT conv_id, e.audit AS audit, generate_subscripts(string_split(e.audit, ''), 1) AS place,
                       unnest(string_split(e.audit, '')) AS letter FROM ends WHERE e.audit <> ''),
    placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER o AS i, count(*) FILTER (letter <> 'D') OVER o AS out_i
               FROM letters WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
    shown AS (SELECT p.conv_id, p.out_i, p.letter, f.role, f.text,
                     min(CASE WHEN p.out_i = 1 THEN CASE WHEN p.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END END)
                         OVER (PARTITION BY p.conv_id) AS shift
              FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.letter <> 'I'
              WHERE p.letter <> 'D'),
    digests AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (out_i - shift) % 2 = 1 THEN 'user'
                                                  ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY out_i)) AS sha
                FROM shown GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost,
           coalesce(e.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN digests ON digests.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLES: dict[str, str] = {
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_quality_rules": _quality_rules_sql(),
    "op13_conversation_repair": _REPAIR_SQL,
}
