"""Mixing, sharding, packing and the archive against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from anomalens.llm import mixing, packing, sharding, warc
from anomalens.llm.queries import tokenizer_path


def test_targets_by_hand():
    assert mixing.targets_of({"b": 100, "a": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = mixing.targets_of({"a": 10, "b": 100, "c": 190})  # a stops at 30, the rest is shared 2 : 1
    assert got == {"a": 30.0, "b": pytest.approx(180.0), "c": pytest.approx(90.0)}
    assert mixing.targets_of({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0} and mixing.targets_of({}) == {}


def test_lengths_fit_exactly_where_they_can():
    r = random.Random(4)
    for _ in range(60):
        n = np.array(sorted(r.sample(range(0, 60), 6)))
        c = np.array([r.randint(1, 5) for _ in n])
        total = int((n * c).sum())
        target = r.uniform(0, 3 * total)
        passes, extra = mixing.fit_lengths(n, c, target, window=r.choice([5, 40, 1000]))
        assert (extra >= 0).all() and (extra <= c).all() and passes + (extra.max() > 0) <= 3
        # A greedy start costs at most the longest length.
        assert abs(passes * total + int((n * extra).sum()) - target) <= n.max()
    _, extra = mixing.fit_lengths(np.array([3, 5]), np.array([4, 4]), 19.0)
    assert 3 * extra[0] + 5 * extra[1] == 19
    _, extra = mixing.fit_lengths(np.array([1000]), np.array([1]), 600.0)  # 1000 is nearer than 0
    assert extra.tolist() == [1]


def test_lengths_give_the_nearest_sum():
    r = random.Random(9)
    for _ in range(400):
        n = np.array(sorted(r.sample(range(0, 70), r.randint(1, 5))))
        c = np.array([r.randint(1, 4) for _ in n])
        total = int((n * c).sum())
        target = r.uniform(0, 3 * total)
        sums = {0}
        for size, many in zip(n, c):
            sums = {s + int(size) * k for s in sums for k in range(many + 1)}
        passes, extra = mixing.fit_lengths(n, c, target)
        assert (extra >= 0).all() and (extra <= c).all()
        got = passes * total + int((n * extra).sum())
        want = min(abs(p * total + s - target) for p in range(3) for s in sums)
        assert abs(abs(got - target) - want) < 1e-9
    # Two lengths, many documents: only giving back documents of one reaches the target.
    n, c = np.array([9, 55]), np.array([10 ** 6, 10 ** 6])
    for target in (30_000_001, 31_234_567, 60_000_007):
        passes, extra = mixing.fit_lengths(n, c, float(target))
        assert passes * int((n * c).sum()) + int((n * extra).sum()) == target


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_mix(docs, chunk):
    got = mixing.mix(docs, chunk_rows=chunk)
    rows = got.collect()
    assert len(rows) == docs.count() and set(got.columns) == {*docs.columns, "size", "source_size", "target", "repeats"}
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").replace("\x85", "x").split()) and 0 <= r.repeats <= 3
        by[r.source].append(r)
    for source, rs in by.items():
        total = sum(r.size for r in rs)
        assert {r.source_size for r in rs} == {total}
        short = max((r.size for r in rs if r.size < total / 3), default=0)
        assert abs(sum(r.size * r.repeats for r in rs) - rs[0].target) <= max(short, 1) or source is not None
    again = Counter((r.doc_id, r.text, r.repeats) for r in mixing.mix(docs.repartition(5), chunk_rows=chunk).collect())
    assert again == Counter((r.doc_id, r.text, r.repeats) for r in rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in rows)


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.repeats for r in mixing.mix(blank).collect()] == [0, 0]


def jump_by_hand(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 500)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_by_hand(int(k) % 2 ** 64, shards) for k in keys]


def test_shards(spark, docs, no_docs):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    rows = sharding.assign_shards(many, chunk_rows=100).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 0.03 < np.mean([r.grown_shard == 16 for r in rows]) < 0.09
    got = sharding.assign_shards(docs).collect()
    assert len(got) == docs.count() and len({(r.shard, r.slot) for r in got}) == len(got)
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {r.doc_id for r in got})
    null = spark.createDataFrame([(None,), (None,), (1,)], "doc_id long")
    assert sorted((r.shard, r.slot) for r in sharding.assign_shards(null, shards=1).collect()) == [(0, 0), (0, 1), (0, 2)]
    assert sharding.assign_shards(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(many, shards=0)


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \tb", "\n\n a", "x'll y", "don't  'tis", "é ü ß   z",
       "日本 語。x", "a" * 500, "1 22 ３ ½", "<|endoftext|> b <|endoftext|>", "_a_ $$ ||", "\x1c a\x85 b", "🙂 🙂🙂"]


def test_ids_equal_the_tokenizers_library(texts):
    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = True
    encode = packing.Encoder(tokenizer_path())
    assert encode._fast is not None
    for t in [*ODD, *(x for x in texts if x)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t[:40]


def test_added_tokens_keep_their_ids(spark, texts, tmp_path):
    """Against the library as it comes, also through the whole operator."""
    plain = Tokenizer.from_file(tokenizer_path())
    encode = packing.Encoder(tokenizer_path(), added=True)
    assert encode._fast is not None
    odd = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext |>", "<|endoftext|"]
    for t in [*odd, *(x for x in texts if x)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:40]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in packing.pack(df, tokenizer_path()).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*plain.encode(odd[r.doc_id], add_special_tokens=False).ids, 2]
    # An added token that is no special one, in any text.
    plain.add_tokens(["ko"])
    plain.save(str(tmp_path / "t.json"))
    encode = packing.Encoder(str(tmp_path / "t.json"), added=True)
    for t in odd + ["a ko b", "kokoko"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_bins_follow_best_fit():
    """Against a plain list of bins: tightest fit, the fullest closes first."""
    r = random.Random(2)
    bins, plain, loads = packing.Bins(100, 8), [], {}
    for _ in range(2000):
        n = r.randint(1, 100)
        name, offset = bins.place(n)
        fits = [b for b in plain if 100 - loads[b] >= n]
        if fits:
            assert 100 - loads[name] == min(100 - loads[b] for b in fits)
        else:
            if len(plain) >= 8:
                plain.remove(next(b for b in plain if b not in bins.open()))
            plain.append(name)
            loads[name] = 0
        assert offset == loads[name]
        loads[name] += n
        if loads[name] == 100:
            plain.remove(name)
        assert bins.open() == set(plain) and len(plain) <= 8


def check_pack(df, got, size):
    want, pieces, seqs = Counter(), defaultdict(list), defaultdict(list)
    encode = packing.Encoder(tokenizer_path())
    for r in df.collect():
        ids = encode(r.text or "") + (2).to_bytes(4, "little")
        many = len(ids) // 4
        cut, piece, low = many % size or size, 0, 0
        while low < many:
            want[r.doc_id, piece, low, ids[4 * low:4 * cut]] += 1
            piece, low, cut = piece + 1, cut, cut + size
    for r in got.collect():
        pieces[r.doc_id, r.piece, r.start, bytes(r.ids)].append(r)
        assert r.length == len(r.ids) // 4
        seqs[r.sequence_id].append((r.offset, r.length))
    assert Counter({k: len(v) for k, v in pieces.items()}) == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs), sum(n for s in seqs.values() for _, n in s)


def test_packing(docs, no_docs):
    small = docs.filter("length(text) < 10000 OR text IS NULL")
    n, total = check_pack(small, packing.pack(small.repartition(4), tokenizer_path(), size=64), 64)
    assert n <= 1.15 * total / 64 + 2
    check_pack(docs, packing.pack(docs, tokenizer_path(), open_bins=1), 1024)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_small_splits_cost_no_space(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', cast(id % 60 as int))").alias("text"))
    apart, _ = check_pack(df, packing.pack(df.repartition(40), tokenizer_path(), size=128), 128)
    whole, _ = check_pack(df, packing.pack(df.coalesce(1), tokenizer_path(), size=128), 128)
    assert apart <= 1.05 * whole + 1


def test_other_tokenizers_take_the_library(tmp_path):
    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    encode = packing.Encoder(str(tmp_path / "t.json"))
    assert encode._fast is None and np.frombuffer(encode("b a c"), "<u4").tolist() == [1, 0, 2]


@pytest.fixture()
def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", "x\r\n\r\ny", "", None, "é" * 1000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "<p>a</p>"]
    rows = [(i * 5 % 9, f"http://h/{i} x\r\nEvil: 1" if i % 2 else None, h, "z") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[0], (None, "u", "x\r\n\r\ny", "z")],
                                 "page_id long, url string, html string, kind string")


@pytest.mark.parametrize("most", [0, 1000])
def test_archive_round_trip(spark, pages, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    path, files = str(tmp_path / "store"), str(tmp_path / "warc")
    warc.write_archive(pages, path)
    rows = pages.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.html or ""].append(r.page_id)
    assert spark.read.parquet(f"{path}/payloads").count() == len(groups)
    back = warc.read_archive(spark, path).collect()
    assert Counter((r.id, bytes(r.payload).decode()) for r in back) == Counter((r.page_id, r.html or "") for r in rows)
    warc.write_warc(spark, path, files)
    records = warc.read_warc(spark, files).collect()
    assert len(records) == len(rows)
    want = Counter()
    for html, ids in groups.items():
        b = html.encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        order = sorted(ids, key=lambda i: (i is None, i))
        for n, i in enumerate(order):
            name = lambda x: f"<urn:page:{'' if x is None else x}>"
            want[name(i), "revisit" if n else "response", digest, name(order[0]) if n else None, len(b), b"" if n else b] += 1
    assert Counter((r.record_id, r.record_type, r.payload_digest, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in records) == want
    assert not [r for r in records if "\n" in r.uri]


def test_small_payloads_and_damage(spark, pages, tmp_path):
    path = str(tmp_path / "store")
    warc.write_archive(pages, path, least=5)
    kinds = Counter((r.kind, r.bytes) for r in warc.read_archive(spark, path).collect())
    assert kinds["response", 0] == 2 and kinds["revisit", 8] == 3
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"no")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{path}2").collect()
    body = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nWARC-Payload-Digest: "
                         b"sha1:AAAA\r\nX-Payload-Length: 1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    with pytest.raises(ValueError, match="damaged record"):
        list(warc.parse(gzip.open(io.BytesIO(body))))


def test_empty_archive(spark, pages, tmp_path):
    path = str(tmp_path / "store")
    warc.write_archive(pages.filter("false"), path)
    warc.write_warc(spark, path, str(tmp_path / "warc"))
    assert warc.read_archive(spark, path).count() == 0 and warc.read_warc(spark, str(tmp_path / "warc")).count() == 0
