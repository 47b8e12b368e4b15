"""Neighbours, toxicity, quality and the pipeline: brute force and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anomalens.llm import neighbours, quality, toxicity, training

SF = "/root/testdata/sf0.01"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        hits = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = hits[:k]
    return out


def check_neighbours(df, k, least):
    good = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in df.collect()
            if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    queries = [i for i in good if i % 20 == 0]
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(good, queries, k)
    found = total = 0
    for q in queries:
        rows = got.get(q, [])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        for r in rows:
            assert r.score == pytest.approx(float(np.dot(good[q], good[r.vec_id])), abs=1e-12)
        found += len({r.vec_id for r in rows} & {i for _, i in want[q]})
        total += len(want[q])
    assert set(got) <= set(queries) and found >= least * total


def test_recall_of_random_unit_vectors(spark):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    check_neighbours(df, 20, 0.9)


def test_equal_and_unfit_vectors(spark, monkeypatch):
    """Copies are complete and ordered; buckets are cut; odd vectors take no part."""
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 7)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[0] if i % 3 == 0 else base[i % 40]).tolist(), "x") for i in range(200)]
    rows += [(1000, None, ""), (1001, [0.0] * 8, ""), (1020, [float("nan")] * 8, ""), (1002, [1.0, None], ""),
             (1040, [float("inf"), 1.0], ""), (1060, [1.0, 2.0], ""), (1061, [2.0, 1.0], ""), (None, [1.0] * 8, ""), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")
    check_neighbours(df, 20, 1.0)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i - 3), 1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<float>")
    check_neighbours(df, 20, 1.0)
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") >= 0).count() == 0
    assert neighbours.nearest(df, F.lit(False)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(9)
    terms = {"".join(r.choice("abcd") for _ in range(r.randint(3, 9))): 1.0 for _ in range(60)}
    for edits in (0, 1, 2):
        lexicon = toxicity.Lexicon(terms, edits, fuzzy=5)
        for _ in range(600):
            t = r.choice(list(terms))
            word = list(t) if r.random() < 0.7 else [r.choice("abcd") for _ in range(6)]
            for _ in range(r.randint(0, 2)):
                p = r.randrange(len(word) + 1)
                word[p:p + r.randint(0, 1)] = [r.choice("abcde")] * r.randint(0, 1)
            word = "".join(word)
            near = [(distance(word, x), x) for x in terms if distance(word, x) <= (edits if len(x) >= 5 else 0)]
            want = min(near) if near else None
            got = lexicon.match(word)
            assert got == ((want[1], want[0]) if want else None), (word, got, want)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"scumbag": 4.0, "rotter": 4.0})
    count = lambda t: dict(zip(toxicity.FEATURES, toxicity.features_of(t, lexicon)))
    assert count('they wrote "you scumbag" and left')["abuse"] == 0 < count('they wrote "you scumbag" and left')["quoted"]
    assert count("you scumbag, you don't know")["abuse"] == pytest.approx(np.log(2))
    assert count("you scumbg")["abuse_misspelt"] == count("you scumbbag")["abuse_misspelt"] == pytest.approx(np.log(2))
    far = '"' + "word " * 20 + "rotter " + "word " * 20 + '"'
    assert count(far)["quoted"] == 0 < count(far)["abuse"]
    assert set(toxicity.features_of("", lexicon)) == {0.0} == set(toxicity.features_of("fine words", lexicon))


@pytest.mark.parametrize("text, abuse, quoted", [
    ("You’re a scumbag and you don’t know", 1, 0),
    ("you‘re a scumbag and don‘t know", 1, 0),
    ('"hello," you scumbag, "good bye" then', 1, 0),
    ('it is 5" wide, you scumbag, and 6" tall', 1, 0),
    ('then "you scumbag and no end', 1, 0),
    ("'tis true, you scumbag, the dogs' bowl", 1, 0),
    ('"you scumbag"', 1, 0),
    ("they wrote “you scumbag” and left", 0, 1),
    ("they wrote „you scumbag“, « you rotter » and »scumbag« and ‘rotter’", 0, 4),
    ("they wrote “he’s a scumbag, isn’t he” and left", 0, 1),
    ('they wrote "' + "word " * 20 + "rotter " + "word " * 20 + '" and left', 0, 1),
    ("they wrote “one scumbag\n\n“two rotter” and left", 0, 2),
    ('he said "a scumbag" and "b" but you rotter "c" too', 1, 1),
])
def test_hits_are_quoted_inside_a_pair_only(text, abuse, quoted):
    lexicon = toxicity.Lexicon({"scumbag": 4.0, "rotter": 4.0})
    got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, lexicon)))
    assert (got["abuse"], got["quoted"]) == pytest.approx((np.log1p(abuse), np.log1p(quoted)))


@pytest.mark.parametrize("text, abuse, misspelt", [
    ("you id1ot", 0, 1), ("you cl0wn!", 0, 1), ("a st*pid, st_pid one", 0, 2), ("you idoit, iidot", 0, 2),
    ("*scu* and sc*m", 0, 2), ("you,id1ot", 0, 1), ("1diot $tupid", 0, 2), ("idiot's idiot-like you/idiot.clown", 4, 0),
    ("scam", 0, 1), ("loss", 0, 0),
])
def test_misspellings_with_digits_symbols_and_swaps(text, abuse, misspelt):
    lexicon = toxicity.Lexicon(dict.fromkeys(["idiot", "clown", "stupid", "scum", "lose"], 1.0), swaps=True,
                               strict=frozenset(["lose"]))
    got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, lexicon)))
    assert (got["abuse"], got["abuse_misspelt"]) == pytest.approx((np.log1p(abuse), np.log1p(misspelt)))


def test_short_terms_are_fuzzy_by_measured_false_hits(spark):
    rows = [(i, 1, i % 2, "you scum lose") for i in range(10)] + [(i, 0, i % 2, "at a loss here") for i in range(10, 20)]
    sample = spark.createDataFrame(rows, "k int, y int, part int, text string")
    assert toxicity.strict_terms(sample, toxicity.count_words(sample), {"scum": 1.0, "lose": 1.0}) == {"lose"}


def distance_with_swaps(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, new[-1] + 1))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def test_automaton_counts_a_swap_as_one_edit():
    r = random.Random(5)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(2, 7))): 1.0 for _ in range(40)}
    lexicon = toxicity.Lexicon(terms, 1, fuzzy=3, swaps=True)
    for _ in range(1500):
        word = "".join(r.choice("abcd") for _ in range(r.randint(1, 8)))
        near = [(distance_with_swaps(word, t), t) for t in terms]
        near = [(d, t) for d, t in near if d <= (len(t) >= 3)]
        assert lexicon.match(word) == (min(near)[::-1] if near else None), word


def accuracy(df, labels, label):
    rows = df.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").filter("held_out").collect()
    pairs = [(r.score, r.y) for r in rows]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    return auc, np.mean([r.predicted == r.y for r in rows])


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables["documents"], tables["labels"]
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.train(docs, labels))
    auc, right = accuracy(got, labels, "toxic")
    assert auc > 0.85 and right > 0.93 and got.count() == docs.count()
    held = docs.filter(training.remainder("doc_id", 3) == 1)
    blind = labels.withColumn("toxic", F.when(training.remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(held, toxicity.train(docs, blind))
    assert {r.doc_id: r.score for r in again.collect()} == {r.doc_id: r.score for r in got.filter("held_out").collect()}


def test_quality_on_held_out_rows(tables):
    docs, labels = tables["documents"], tables["labels"]
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    auc, right = accuracy(got, labels, "quality")
    assert auc > 0.95 and right > 0.95 and 0 < len(model.rules) < 200
    # The compiled column and the rules in plain numpy agree.
    rows = got.limit(200).collect()
    x = np.array([[r[s] for s in quality.STATISTICS] for r in rows])
    total = model.bias + sum(w * quality.holds(rule, x) for rule, w in zip(model.rules, model.weights))
    assert np.allclose(training.sigmoid(total), [r.score for r in rows])


def test_statistics_by_hand(spark, docs):
    df = docs.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    got = quality.with_statistics(df.withColumn("t", F.col("text"))).collect()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.t)
        b, n = r.t.encode(), max(1, len(words))
        lines = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in r.t.split("\n")]
        lines = [tuple(x) for x in lines if x]
        want = {"bytes": len(b), "words": len(words), "lines": len(lines),
                "mean_word": sum(len(w.encode()) for w in words) / n,
                "distinct_words": len({w.translate({i: i + 32 for i in range(65, 91)}) for w in words}) / n,
                "sentence_ends": sum(w[-1] in ".!?" for w in words) / n,
                "repeated_lines": (len(lines) - len({tuple(w.lower() for w in x) for x in lines})) / max(1, len(lines)),
                "short_lines": sum(len(x) < 4 for x in lines) / max(1, len(lines)),
                "line_ends": r.t.count("\n") / max(1, len(b)), "capital_words": sum("A" <= w[0] <= "Z" for w in words) / n}
        assert {k: r[k] for k in want} == pytest.approx(want), r.t[:50]


def test_models_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(0, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for labels in (none, one):
        t, q = toxicity.train(docs, labels), quality.train(docs, labels)
        for got in (toxicity.score(docs, t), quality.score(docs, q)):
            rows = got.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert toxicity.score(no_docs, t).count() == quality.score(no_docs, q).count() == 0


def test_pipeline(spark, tables):
    """Every stage returns what its operator decides, over all that came in."""
    docs, path = tables["documents"], SF
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == tables["documents"].columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts[name] = docs.count()
    total = tables["documents"].count()
    assert 0.8 * total < counts["toxicity"] < total
    assert total > counts["toxicity"] > counts["exact_dedup"] > counts["ngram_join"] > 0.7 * total
    whole = corpus_pipeline.run(spark, path)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, pieces.select(key).collect()))


def test_a_lexicon_keeps_a_bounded_number_of_answers():
    from anomalens.llm.toxicity import Lexicon
    lexicon = Lexicon({"scoundrel": 1.0}, swaps=True)
    for i in range(150_000):
        lexicon.hits(f"q{i}")
    assert len(lexicon._tokens) <= 100_000 and len(lexicon._kept) <= 100_000
    assert lexicon.hits("scoundrel")[1] == ((0, "scoundrel", 0),)
