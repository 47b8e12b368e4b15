"""Quality rules against a plain count."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anomalens.llm import quality_rules as Q
from anomalens.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(x in "#*$%&|<>" for x in text),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_marks": sum(x in "!?" for x in text),
         "n_stop_words": sum(w in Q.STOP_WORDS for w in words), "n_lines": len(lines),
         "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines),
         "n_open_lines": sum(x.rstrip(" \t\n\v\f\r").endswith(("...", "…")) for x in lines)}
    base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    broken = [r.name for r in Q.RULES if (r.least is not None and 100 * c[r.count] < r.least * c[r.of])
              or (r.most is not None and 100 * c[r.count] > r.most * c[r.of])]
    return {**c, "base_failed": base, "broken": broken, "kept": not base and not broken}


TEXTS = [None, "", " \t\x0b\n", "a b c a b c", "a a a a", "one two", "# * $ % & | < > !?", "\n\n- x\n- x\n• y...\n z…",
         "the cat and the dog " * 30, " ".join(f"w{i}" for i in range(80)) + " the of and in a is it", "x" * 100_000,
         " ".join(f"w{i % 999}" for i in range(30_000)), " nb sp é́ \U0001f600 end", "A\x00B \x1f c\x85d"]


def test_counts(spark, texts):
    given = TEXTS + texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    for r in Q.judge(df).collect():
        want = plain(given[r.doc_id])
        assert {n: r[n] for n in want} == want, given[r.doc_id]


def test_edges(spark, docs, no_docs):
    got = Q.judge(docs.withColumn("N_Words", F.lit("x")).withColumn("a.b", F.lit(1)))
    assert got.count() == docs.count() and [c.lower() for c in got.columns].count("n_words") == 1 and "a.b" in got.columns
    assert Q.judge(no_docs).count() == 0
    assert Q.judge(docs, rules=()).filter("kept = base_failed").count() == 0


def test_plan_is_one_narrow_projection(spark, docs):
    plan = Q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Window"))


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_quality_rules(spark, str(tmp_path))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got.columns == ["doc_id", *names]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        want = plain(texts[r.doc_id])
        assert [r[n] for n in names] == [want[n] for n in names]
