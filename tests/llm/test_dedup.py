"""Exact dedup, suffix dedup and the n-gram join against brute force."""

import hashlib
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomalens.llm import exact_dedup, ngram_join, suffix_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def normal(text):
    return (text or "").translate(LOWER)


def test_copies_equal_brute_force(docs):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    got = exact_dedup.group_copies(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, max(groups[normal(r.text)]), len(groups[normal(r.text)]),
                    hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_kept_rows_keep_their_columns(docs, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", limit)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    best = {}
    for r in docs.collect():
        best[normal(r.text)] = max(best.get(normal(r.text), -1), r.doc_id)
    assert sorted((normal(r.text), r.doc_id) for r in got) == sorted(best.items())


def test_the_filter_names_all_repeated_hashes_and_few_others(spark):
    # 20,000 hashes once, 500 twice, one 3,000 times.
    once, twice = spark.range(20_000), spark.range(20_000, 20_500)
    hot = spark.range(3_000).select(F.lit(99_999).cast("long").alias("id"))
    hashes = once.union(twice).union(twice).union(hot).select(F.xxhash64("id").alias("h"))
    found = {r.h for r in exact_dedup._maybe_repeated(hashes).collect()}
    want = {r.h for r in twice.union(hot.limit(1)).select(F.xxhash64("id").alias("h")).collect()}
    assert want <= found and len(found) < len(want) + 0.1 * 20_000


def test_single_rows_pass_without_an_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 99).alias("text"))
    single, double = exact_dedup._split(df.select(F.col("text"), exact_dedup.text_digest("text").alias("sha")))
    plan = single._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert single.count() + double.count() == 100 and double.filter("text = 't0'").count() == 2


def test_null_keys_and_empty_tables(spark, no_docs):
    df = spark.createDataFrame([(None, "a"), (3, "A"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.group_copies(df).collect()
    assert sorted((r.text_sha256[:4], r.keep_id, r.kept) for r in got if r.group_size == 2 and r.keep_id) == [
        (hashlib.sha256(b"a").hexdigest()[:4], 3, False), (hashlib.sha256(b"a").hexdigest()[:4], 3, True)]
    assert sum(r.kept for r in got) == 2
    assert exact_dedup.group_copies(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0


def removed(rows, window=50):
    """(id, text) -> removed bytes, by a dictionary of all windows."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < i:
                gone[p:p + window] = b"\1" * window
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g),
                    [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    return Counter((i, n, k, tuple(s)) for i, n, k, s in out)


def check_removed(df, window=50):
    got = suffix_dedup.remove_repeats(df, window).collect()
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in got)
    assert got == removed([(r.doc_id, r.text) for r in df.collect()], window)


def test_repeats_equal_brute_force(docs):
    check_removed(docs)


def test_repeats_in_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BUCKET", 5000)
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET", 3000)
    check_removed(docs.filter("length(text) < 10000 OR text IS NULL").repartition(5))


def test_repeats_of_low_variety_texts(spark):
    """Two letters: anchors tie, windows overlap themselves."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(["a", "b"], int(n), p=[0.93, 0.07])) for n in rng.integers(0, 400, 40)]
    check_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    check_removed(spark.createDataFrame([(2, "ab" * 60), (1, "ba" * 60), (0, "ab" * 25)], "doc_id long, text string"), 40)


def test_repeats_of_nul_bytes(spark):
    """Sixteen NUL bytes have the smallest hash."""
    nul = "\0"
    texts = [nul * 90, nul * 70, "head " + nul * 60 + " tail", "x" * 40 + nul * 16 + "y" * 40, "z" * 9 + "x" * 40 + nul * 16 + "y" * 40,
             "a" * 30 + nul * 17 + "b" * 30, "c" + "a" * 30 + nul * 17 + "b" * 30 + nul * 200, nul * 15 + "a" * 30 + nul * 17 + "b" * 30]
    check_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.mark.parametrize("window", [70, 79])
def test_repeats_of_long_windows(spark, window):
    rng = np.random.default_rng(8)
    copied = "".join(rng.choice(list("abcdefgh"), 300))
    texts = [copied, *("k" * i + copied[i:i + 200] + "m" * i for i in range(0, 100, 7))]
    check_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(0, "a")], "doc_id long, text string"), 80)


def test_null_id_ranks_first(spark, no_docs):
    df = spark.createDataFrame([(None, "x" * 60), (1, "x" * 70), (1, "y" * 60), (1, "y" * 60)], "doc_id int, text string")
    got = Counter((r.doc_id, len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == {(None, 60): 1, (1, 0): 1, (1, 60): 2}
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", normal(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(rows):
    """(id, n_shingles, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check_linked(df):
    got = Counter(tuple(r) for r in ngram_join.components(df).collect())
    assert got == linked([(r.doc_id, r.text) for r in df.collect()])


def test_components_equal_brute_force(docs):
    check_linked(docs)


def test_components_in_many_parts(docs, monkeypatch):
    for name, value in (("BUCKET_BYTES", 2000), ("FRAGMENT_NGRAMS", 200), ("GROUP_DOCS", 4), ("BROADCAST_KEYS", 0), ("_BLOCK", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    check_linked(docs.filter("length(text) < 10000 OR text IS NULL").repartition(4))


def test_chains_at_the_threshold(spark):
    """Windows over one word list: neighbours link, ends of the chain do not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * step:i * step + 60])) for step in (7, 8, 9) for i in range(12)]
    rows += [(500 + i, " ".join(words[:k])) for i, k in enumerate((5, 6, 7, 8, 4, 3))]
    check_linked(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))


def test_one_document_of_a_component_stays(docs, no_docs):
    got = ngram_join.drop_linked(docs)
    assert got.columns == docs.columns
    found = linked([(r.doc_id, r.text) for r in docs.collect()])
    want = {d for (d, n, c) in found if d == c}
    assert {r.doc_id for r in got.collect()} == want
    assert ngram_join.components(no_docs).count() == 0 and ngram_join.drop_linked(no_docs).count() == 0


def test_native_plan(docs):
    """No Python on the path of exact dedup."""
    for df in (exact_dedup.group_copies(docs), exact_dedup.drop_copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
