import math
import random
import re
import shutil
from collections import Counter

import pytest

from anomalens.operators import retrieval as I

ENTRIES = [
    ("m.late", "metric", "晚点 率", "late 指晚点五分钟以上的车次占比，trips.delay 计算", ["late", "晚点率"], ["trips"]),
    ("m.lost", "metric", "损失客时", "sum of delay times riders, late trips only", ["客时", "late"], ["trips"]),
    ("t.start", "table_note", "发车时刻", "start_ts holds local time", ["start_ts", "hour"], []),
    ("r.stop", "relation", "trips and stations", "a trip begins at the stations row of its first stop", ["stop", "platform"], ["trips", "stations"]),
    ("same.1", "metric", "", "alpha beta beta", [], []),
    ("same.2", "metric", "", "alpha beta beta", [], []),
    ("tag.only", "metric", "", "!!", ["zz"], ["other"]),
    ("empty.tag", "metric", "", "", [""], []),
]
QUERIES = ["LATE 晚点 率", "alpha", "buzz unseen", "损失客时 late 客时", "start_ts hour hour", "  ", "?!", "stations stop", "晚  点"]


def tokens(text):
    text = text.lower()
    cjk = re.findall("[一-鿿]", text)
    return re.findall(r"[a-z_][a-z0-9_]*|\d+", text) + [a + b for a, b in zip(cjk, cjk[1:])] + cjk


def brute_force(entries, query, k, kind=None, tables=None):
    docs = [Counter(tokens(" ".join([e[2], e[3], " ".join(e[4])]))) for e in entries]
    df = Counter(t for d in docs for t in d)
    weigh = lambda c: {t: (1 + math.log(x)) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t, x in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    q = weigh(Counter(tokens(query)))
    hits = []
    for i, (e, d) in enumerate(zip(entries, docs)):
        if not q or (kind and e[1] != kind) or (tables and e[5] and not set(tables) & set(e[5])):
            continue
        w = weigh(d)
        s = sum(x * q.get(t, 0) for t, x in w.items()) / norm(w) / norm(q)
        s += sum(0.25 for t in e[4] if t.lower() in query.lower()) + (0.35 if e[2] and e[2].lower() in query.lower() else 0)
        if s > 0:
            hits.append((-round(s, 12), i, e[0], s))
    return [(h[2], pytest.approx(h[3])) for h in sorted(hits)[:k]]


def frame(spark, entries):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(entries)],
                                 "id string, kind string, title string, text string, tags array<string>, "
                                 "tables array<string>, ord long")


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(frame(spark, ENTRIES))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")


@pytest.mark.parametrize("plan_postings", [0, 10 ** 9])
@pytest.mark.parametrize("k,kind,tables", [(3, None, None), (20, None, None), (20, "metric", None), (20, None, ["stations"])])
def test_search_equals_brute_force(index, queries, monkeypatch, k, kind, tables, plan_postings):
    monkeypatch.setattr(I, "PLAN_POSTINGS", plan_postings)
    got = {}
    for r in I.search(index, queries, k, kind, tables).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    for i, q in enumerate(QUERIES):
        assert got.get(i, []) == brute_force(ENTRIES, q, k, kind, tables), q


def drawn(n, seed=5):
    """Entries of frequent and rare words; some share a passage, some a tag or a title."""
    r = random.Random(seed)
    frequent, rare = [f"f{i}" for i in range(12)], [f"r{i}" for i in range(600)]
    passage = " ".join(r.sample(rare, 12))
    out = []
    for i in range(n):
        words = r.choices(frequent, k=r.randrange(5, 25)) + r.choices(rare, k=r.randrange(2, 12)) + passage.split() * (i % 40 == 0)
        r.shuffle(words)
        out.append((f"e{i}", ["metric", "table_note"][i % 2], f"name {i % 7}", " ".join(words), [f"f{i % 3}"], []))
    asks = [passage + " " + " ".join(frequent[:6]), " ".join(frequent), "name 3 " + passage, *[" ".join(r.choices(rare, k=6) + r.choices(frequent, k=6)) for _ in range(12)]]
    return out, asks


def test_blocks_left_out_lose_no_hit(spark, monkeypatch):
    monkeypatch.setattr(I, "PLAN_POSTINGS", 0)
    monkeypatch.setattr(I, "BLOCK_POSTINGS", 16)
    entries, asks = drawn(400)
    index, queries = I.build_index(frame(spark, entries)), spark.createDataFrame(list(enumerate(asks)), "qid int, query string")
    for kind in (None, "metric"):
        got = {}
        for r in I.search(index, queries, 3, kind).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
        assert [got[i] for i in range(len(asks))] == [brute_force(entries, q, 3, kind) for q in asks]
    plan = I.search_plan(index, I._asked(index, queries), 3).orderBy("qid").collect()
    # A query that entries answer well reads few of its blocks.
    assert plan[0].blocks_read < 0.5 * plan[0].blocks and all(p.blocks_read <= p.blocks for p in plan)


def test_requests(spark, index):
    asked = spark.createDataFrame([(0, "late", 0), (1, "late", 1), (2, "late", 99), (3, " \t", 3), (4, "?!", None)],
                                  "qid int, query string, top_k int")
    rows = I.retrieve(index, asked).collect()
    n = Counter(r.qid for r in rows if r.id)
    assert (n[0], n[1], n[2]) == (3, 1, 3) and [r.error for r in rows if r.qid == 3] == ["empty_query"]
    assert [(r.error, r.id) for r in rows if r.qid == 4] == [(None, None)]
    assert [I.clamp_k(x) for x in (None, 0, 1, 9, -2)] == [3, 3, 1, 5, 1]


def test_added_entries_change_the_index(spark, index, queries):
    more = [("m.new", "metric", "buzz", "unseen buzz", [], [])]
    both = I.extend_index(index, frame(spark, more))
    got = I.search(both, queries.filter("qid = 2"), 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == brute_force(ENTRIES + more, QUERIES[2], 5)


def test_adding_reads_new_entries_only(spark, tmp_path):
    """The texts of indexed entries may be gone when others are added; segments that are
    merged give the same index."""
    entries, asks = drawn(60)
    at, parts = str(tmp_path / "entries"), [entries[:20], entries[20:40], entries[40:50], entries[50:]]
    frame(spark, parts[0]).write.parquet(at)
    index = I.build_index(spark.read.parquet(at))
    shutil.rmtree(at)
    for part in parts[1:]:
        index = I.extend_index(index, frame(spark, part))
    queries = spark.createDataFrame(list(enumerate(asks)), "qid int, query string")
    assert len(index.segments) == 4
    for x in (index, I.assemble((I.compact(index.segments),))):
        got = {}
        for r in I.search(x, queries, 4).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
        assert [got[i] for i in range(len(asks))] == [brute_force(entries, q, 4) for q in asks]


def test_phrases_of_a_query(index, queries):
    got = {(r.qid, r.phrase): (r.boost, r.owners) for r in I.boosts(index, queries).collect()}
    assert got[0, "晚点 率"] == (0.35, 1) and got[0, "late"] == (0.25, 2) and got[1, ""] == (0.25, 1)
    assert not [k for k in got if k[0] in (5, 6)]  # no tokens, no phrases


def test_phrase_search_is_linear_in_a_long_query(spark):
    entries = [(f"e{n}", "metric", "word " * n + "end", "x", [], []) for n in range(200)]
    query = "word " * 4000 + "end"
    index = I.build_index(frame(spark, entries))
    asked = spark.createDataFrame([(0, query)], "qid int, query string")
    assert I.boosts(index, asked).count() == 200
    assert [r.id for r in I.search(index, asked, 3).collect()]


@pytest.mark.parametrize("plan_postings", [0, 10 ** 9])
def test_posted_index_gives_the_hits_of_a_scan(spark, monkeypatch, plan_postings):
    monkeypatch.setattr(I, "PLAN_POSTINGS", plan_postings)
    monkeypatch.setattr(I, "BLOCK_POSTINGS", 16)
    entries, asks = drawn(150)
    queries = spark.createDataFrame(list(enumerate(asks)), "qid int, query string")
    index = I.post(I.build_index(frame(spark, entries)))
    assert index.posted
    got = {}
    for r in I.search(index, queries, 3, "metric").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    assert [got[i] for i in range(len(asks))] == [brute_force(entries, q, 3, "metric") for q in asks]


@pytest.mark.parametrize("hot_terms", [200_000, 0])
def test_equal_entries_score_the_same_to_the_last_bit(spark, monkeypatch, hot_terms):
    monkeypatch.setattr(I, "HOT_TERMS", hot_terms)
    r = random.Random(3)
    body = " ".join(r.choices([f"w{i}" for i in range(300)], k=400))
    entries = [(f"e{i}", "metric", "", body if i % 2 else " ".join(r.choices(body.split(), k=50)), [], []) for i in range(80)]
    index = I.build_index(frame(spark, entries).repartition(7))
    asked = spark.createDataFrame([(0, body)], "qid int, query string")
    rows = [x for x in I.search(index, asked, 80).collect() if x.ord % 2]
    assert len(rows) == 40 and len({x.score for x in rows}) == 1
    norms = {x.norm for x in I.lengths(index.segments).collect() if x.ord % 2}
    assert len(norms) == 1


def test_a_scan_shuffles_no_postings(spark, index, queries, capsys):
    I.hits(index, queries, 3).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(ord" in plan and "hashpartitioning(tok" not in plan
    assert "InArrow" not in plan and "Python" not in plan


def test_counts_of_an_entry_are_made_without_python(spark):
    rows = [("a", "metric", "T", "x y x  7 晚点 晚", ["x", None], [], 0), ("b", "metric", None, None, None, None, 1)]
    entries = spark.createDataFrame(rows, "id string, kind string, title string, text string, tags array<string>, tables array<string>, ord long")
    got = {r.ord: dict(zip(r.toks, r.counts)) for r in I.build_segment(entries).entries.collect()}
    assert got == {0: dict(Counter(tokens("T x y x 7 晚点 晚 x"))), 1: {}}
    assert not hasattr(I, "_row_counts")


def test_phrases_need_no_index(spark, index, queries, monkeypatch):
    monkeypatch.setattr(I, "build_segment", None)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(I.phrase_boosts(frame(spark, ENTRIES), queries)) == key(I.boosts(index, queries))
