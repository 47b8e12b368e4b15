"""Documents whose word 5-shingles have a Jaccard similarity of at least 0.75, by
vertical partitioning.

1. Documents that cannot link go first. A link needs three quarters of a document's
   shingles in the other one, so of the shingles in the lower half of the hash space
   all but a quarter of the set's size must occur in another document. Tasks send a
   shingle once per block of documents, so a frequent one is no burden.
2. Equal sets collapse. The global n-gram order (rare before frequent, then by hash)
   is cut into fragments by hash; each fragment counts its n-grams and hands the
   counts back, which gives every document its order and its prefix: two documents
   that link share an n-gram of both prefixes.
3. Prefixes propose pairs. Some rounds test each document with one that stands for
   others, of which the least is its own; documents found linked are one component, and only pairs
   across components are tested after that. All of those are: nothing is capped. An
   overlap cannot exceed the n-grams that either set has in common with any other one,
   so a pair is left out if even that many would not reach the similarity. So is one
   whose sets differ in too many places of a parity bitmap: every place where the
   bitmaps differ is an n-gram in one set only.
4. A pair is tested fragment by fragment: partial overlaps are counted separately and
   summed per pair.

Defined cases: a null text counts as empty; a document of fewer than five words is one
shingle; one without words links with nothing; equal texts always link; rows that
agree in id and text count as one document; null ids never are a component's id unless
all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from anomalens.llm import buffers
from anomalens.llm.common import packed, text_of, unpacked
from anomalens.plans.storage import cut_lineage

WIDTH, PERCENT = 5, 75
BUCKET_BYTES = 4 << 20
FRAGMENT_NGRAMS, GROUP_DOCS, FRAGMENTS = 500_000, 1000, 8
# Keys of candidates are broadcast up to this many, beyond it Spark joins.
BROADCAST_KEYS = 2_000_000
ROUNDS = 3
_BLOCK, _MANY = 4096, 0x3FFF
_HALF = np.uint64(1 << 63)
_MASK = np.uint64(_MANY)
# Words of 64 places in the parity bitmap of a set.
_WORDS = 8
_MARKS = [f"p{i}" for i in range(_WORDS)]


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _bounds(many: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(many)]).astype(np.int64)


def _edges(parts: int, span: int) -> np.ndarray:
    """The inner borders of equal ranges of hashes."""
    return np.array([span * i // parts for i in range(1, parts)], np.uint64)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
               percent: int = PERCENT) -> DataFrame:
    """One row per document: the key, ``n_shingles`` and ``component_id`` (smallest
    key reachable by links)."""
    return _components(docs, text, key, width, percent).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def drop_linked(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a smaller key in their component."""
    found = _components(docs, text, key, width, percent)
    gone = found.filter(~F.col("first")).select(F.col("id").alias("_i"), F.col("key").alias("_k")).distinct()
    rows = packed(docs, i=F.col(key), k=_digest(text))
    rows = rows.join(gone, F.col("i").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k")), "left_anti")
    return unpacked(rows)


def _components(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("id"), _digest(text).alias("key"),
                       text_of(text).alias("text"))
    sized = _possible(rows, width, percent)
    sets = _sets(rows, sized, width)
    numbers = _numbered(sets)
    labels = _labels(sets.select("key", "grams").join(numbers.select("key", "sid", "n"), "key").drop("key"), numbers, percent)
    named = numbers.join(labels, "sid", "left").select("digest", F.coalesce("label", "sid").alias("label"))
    members = sets.select("key", "digest").join(named, "digest").select("key", "label")
    named = sized.filter("n > 0").join(members, "key")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"))
    least = members.join(least, "label").select("key", "least")
    out = sized.join(least, "key", "left")
    linked = (F.col("n") > 0) & F.col("least").isNotNull()
    return out.select("id", "key", "n", F.when(linked, F.col("least.id")).otherwise(F.col("id")).alias("component_id"),
                      F.when(linked, F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.key") == F.col("key")))
                      .otherwise(F.lit(True)).alias("first"))


def _possible(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, key, n, maybe): the size of every document's set, and whether enough of
    it occurs elsewhere. Written."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"bucket int, block bigint, words binary, ids array<{kind}>, keys array<binary>, n array<bigint>, need array<bigint>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                yield from _block(batch, block)
                block += 1

    def _block(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        n, grams, whose = np.zeros(batch.num_rows, np.int64), [], []
        for low, hashes, bounds in buffers.shingles(batch.column(2), width):
            many = np.diff(bounds)
            n[low:low + len(many)] = many
            owner = np.repeat(np.arange(low, low + len(many)), many)
            lower = hashes < _HALF
            grams.append(hashes[lower])
            whose.append(owner[lower])
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        whose = np.concatenate(whose) if whose else np.zeros(0, np.int64)
        need = np.bincount(whose, minlength=len(n)) - n * (100 - percent) // 100
        order = np.argsort(grams, kind="stable")
        grams, whose = grams[order], whose[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(grams)))
        need -= np.bincount(whose[np.repeat(many > 1, many)], minlength=len(n))
        words = (buffers.stir(grams[first]) & ~_MASK) | np.where(many > 1, _MANY, whose[first]).astype(np.uint64)
        # Grams are in order, so buckets are ranges of them.
        cuts = np.searchsorted(grams[first], _edges(buckets, 1 << 63))
        ends = np.concatenate([[0], cuts, [len(words)]])
        full = np.flatnonzero(np.diff(ends))
        m = len(full)
        lists = [pa.concat_arrays([pa.nulls(m, pa.list_(v.type)), pa.ListArray.from_arrays([0, len(n)], v)])
                 for v in (batch.column(0), batch.column(1), pa.array(n), pa.array(need))]
        yield pa.record_batch([
            pa.array([*full.tolist(), block % buckets], pa.int32()), pa.array(np.full(m + 1, block)),
            pa.array([_blob(words[ends[b]:ends[b + 1]]) for b in full] + [None], pa.binary()), *lists],
            names=["bucket", "block", "words", "ids", "keys", "n", "need"])

    def count(table: pa.Table) -> pa.Table:
        sent = table.filter(pc.is_valid(table["words"]))
        states = table.filter(pc.is_null(table["words"]))
        parts = [np.frombuffer(w.as_py(), np.uint64) for w in sent["words"]]
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(words >> np.uint64(14), kind="stable")
        words, place = words[order], place[order]
        gram, doc = words >> np.uint64(14), (words & _MASK).astype(np.uint16)
        same = np.zeros(len(words) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        hit = (same[1:] | same[:-1]) & (doc != _MANY)
        place, doc = place[hit], doc[hit]
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
        ends = np.searchsorted(place, np.arange(len(parts) + 1))
        full = np.flatnonzero(np.diff(ends))
        back = pa.table({"bucket": pa.nulls(len(full), pa.int32()), "block": sent["block"].take(pa.array(full)),
                         "words": pa.array([_blob(doc[ends[i]:ends[i + 1]]) for i in full], pa.binary()),
                         **{c: pa.nulls(len(full), states.schema.field(c).type) for c in ("ids", "keys", "n", "need")}},
                        schema=states.schema)
        return pa.concat_tables([back, states])

    def settle(table: pa.Table) -> pa.Table:
        state = table.filter(pc.is_null(table["words"]))
        n, need = (state[c].combine_chunks().flatten().to_numpy() for c in ("n", "need"))
        found = [np.frombuffer(w.as_py(), np.uint16) for w in table["words"] if w.is_valid]
        found = np.bincount(np.concatenate(found), minlength=len(n)) if found else np.zeros(len(n), np.int64)
        return pa.table({"id": state["ids"].combine_chunks().flatten(), "key": state["keys"].combine_chunks().flatten(),
                         "n": pa.array(n), "maybe": pa.array((n > 0) & (found >= need))})

    sent = rows.mapInArrow(send, schema)
    back = sent.groupBy("bucket").applyInArrow(count, schema)
    return cut_lineage(back.groupBy("block").applyInArrow(settle, f"id {kind}, key binary, n bigint, maybe boolean"))


def _sets(rows: DataFrame, sized: DataFrame, width: int) -> DataFrame:
    """(key, digest, n, grams) of the distinct texts that may link; equal sets have one
    ``digest``. Written."""
    keys = sized.filter("maybe").select("key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    few = rows.join(keys, "key", "left_semi").select("key", "text").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, hashes, bounds in buffers.shingles(batch.column(1), width):
                n = np.diff(bounds)
                yield pa.record_batch([
                    batch.column(0).slice(low, len(n)), pa.array(n),
                    pa.array([_blob(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["key", "n", "grams"])

    sets = few.mapInArrow(run, "key binary, n bigint, grams binary")
    return cut_lineage(sets.withColumn("digest", F.unhex(F.md5("grams"))))


def _numbered(sets: DataFrame) -> DataFrame:
    """(sid, digest, key, n): a number for every distinct set, with one of its texts.
    Rounds carry eight bytes for a set and for a label. Written, so that the numbers stay."""
    one = sets.groupBy("digest").agg(F.min(F.struct("key", "n")).alias("one"))
    return cut_lineage(one.select(F.monotonically_increasing_id().alias("sid"), "digest", "one.key", "one.n"))


def _labels(sets: DataFrame, numbers: DataFrame, percent: int) -> DataFrame:
    """(sid, label) of the sets that link with another one."""
    ordered = _ordered(sets, numbers, percent)
    posts = ordered.select("sid", "n", "s", F.explode("prefix").alias("g"))
    shared = posts.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    posts = cut_lineage(posts.join(shared, "g"))
    labels = None
    edges = None
    tested = None
    for turn in range(ROUNDS + 1):
        now = _relabel(posts, labels)
        mixed = now.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("least"),
                                     F.min(F.struct("label", "sid", "n", "s")).alias("first"),
                                     F.max(F.struct("label", "sid", "n", "s")).alias("last"),
                                     F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "label", "sid", "n", "s"))
                                     .alias("core")).filter("a <> b")
        # Whoever cannot reach even the smallest set under an n-gram has no partner there.
        now = now.join(mixed.select("g", "least", "first", "last", "core"), "g").filter(_reach("n", "s", "least", "s", percent))
        if turn < ROUNDS:
            # The leader of an n-gram stands in another component than the document: the
            # set with the least of its own, or else the first or last one.
            lead = F.when(F.col("core.label") != F.col("label"),
                          F.struct(*[F.col(f"core.{c}").alias(c) for c in ("label", "sid", "n", "s")]))
            lead = lead.when(F.col("first.label") < F.col("label"), F.col("first")).otherwise(F.col("last"))
            now = now.withColumn("lead", lead).filter("lead.label <> label")
            pairs = now.groupBy("sid", "n", "s", F.col("lead.sid").alias("other"), F.col("lead.n").alias("m"),
                                F.col("lead.s").alias("z")).agg(F.count("*").alias("c")).filter(
                _lengths("n", "m", percent) & _reach("n", "s", "m", "z", percent))
            if tested is not None:
                done = tested.select(F.col("a").alias("sid"), F.col("b").alias("other"))
                done = done.unionByName(done.select(F.col("other").alias("sid"), F.col("sid").alias("other")))
                pairs = pairs.join(done, ["sid", "other"], "left_anti")
            best = Window.partitionBy("sid").orderBy(F.desc("c"), "other")
            pairs = pairs.withColumn("r", F.row_number().over(best)).filter("r = 1")
        else:
            # Of two components under an n-gram one at least is not its largest; the largest never meets itself.
            sizes = now.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(
                F.max(F.struct("c", "label")).alias("top")).select("g", F.col("top.label").alias("top"))
            marks = ordered.select("sid", *[F.col("marks")[i].alias(c) for i, c in enumerate(_MARKS)])
            now = cut_lineage(now.select("g", "sid", "n", "s", "label").join(sizes, "g").join(marks, "sid"))
            other = now.select("g", F.col("sid").alias("other"), F.col("n").alias("m"), F.col("s").alias("z"),
                               F.col("label").alias("ol"), *[F.col(c).alias(f"{c}o") for c in _MARKS])
            once = (F.col("ol") == F.col("top")) | (F.col("sid") < F.col("other"))
            pairs = now.filter("label <> top").join(other, "g").filter(
                (F.col("label") != F.col("ol")) & once & _lengths("n", "m", percent)
                & _reach("n", "s", "m", "z", percent) & _alike("n", "s", "m", "z", percent))
        a, b = F.least("sid", "other"), F.greatest("sid", "other")
        pairs = pairs.select(a.alias("a"), b.alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        found = cut_lineage(_linked(pairs, ordered, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        labels = _connected(edges)
    if labels is None:
        labels = posts.select("sid", F.col("sid").alias("label")).limit(0)
    return labels


def _lengths(n: str, m: str, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _reach(n: str, s: str, m: str, z: str, percent: int):
    """Whether sets of sizes n and m could link, if s and z of their n-grams occur elsewhere."""
    most = F.least(s, z)
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def _alike(n: str, s: str, m: str, z: str, percent: int):
    """Whether sets may link by the n-grams that are in one of them for certain: those
    that occur nowhere else, and one for each place where the bitmaps differ."""
    apart = F.col(n) - F.col(s) + F.col(m) - F.col(z)
    for c in _MARKS:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}o")))
    return (100 - percent) * (F.col(n) + F.col(m)) >= (100 + percent) * apart


def _relabel(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posts.withColumn("label", F.col("sid"))
    return posts.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _ordered(sets: DataFrame, numbers: DataFrame, percent: int) -> DataFrame:
    """(sid, n, s, marks, prefix, grams): the ``s`` n-grams that occur in two sets at least, in
    the global order, their parity bitmap, and the part of the prefix among them. Sets without one cannot link and
    are left out. Written."""
    total, count = numbers.agg(F.sum("n"), F.count("*")).first()
    fragments = max(1, -(-(total or 0) // FRAGMENT_NGRAMS))
    groups = max(1, -(-count // GROUP_DOCS))
    schema = "f int, g int, sids array<bigint>, n array<bigint>, many array<bigint>, grams binary, ranks binary"

    def pack_rows(f, g, sids, n, many, grams, ranks) -> pa.RecordBatch:
        return pa.record_batch([
            pa.array(f, pa.int32()), pa.array(g, pa.int32()), pa.array(sids, pa.list_(pa.int64())),
            pa.array(n, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int64())), pa.array(grams, pa.binary()),
            pa.array(ranks, pa.binary())], names=["f", "g", "sids", "n", "many", "grams", "ranks"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _edges(fragments, 1 << 64)
        for batch in batches:
            sids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            group = batch.column(3).to_numpy()
            sets_ = [np.frombuffer(b, np.uint64) for b in batch.column(2).to_pylist()]
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                grams = np.concatenate([sets_[i] for i in own])
                doc = np.repeat(np.arange(len(own)), [len(sets_[i]) for i in own])
                part = np.searchsorted(edge, grams, "right")
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(fragments + 1))
                rows = []
                for f in np.flatnonzero(np.diff(ends)):
                    at = order[ends[f]:ends[f + 1]]
                    who, many = np.unique(doc[at], return_counts=True)
                    rows.append((f, g, [sids[own[i]] for i in who], n[own[who]].tolist(), many.tolist(),
                                 _blob(grams[at]), None))
                if rows:
                    yield pack_rows(*zip(*rows))

    def rank(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), np.uint64) for b in table["grams"]]
        grams = np.concatenate(parts)
        _, where, many = np.unique(grams, return_inverse=True, return_counts=True)
        # Rare first; eight steps to a doubling, one byte.
        step = np.minimum(255, np.floor(8 * np.log2(many))).astype(np.uint8)
        step[many == 1] = 0
        step[(many > 1) & (step == 0)] = 1
        ranks = step[where]
        rows, low = [], 0
        for i, p in enumerate(parts):
            mine = ranks[low:low + len(p)]
            low += len(p)
            keep = mine > 0
            each = np.asarray(table["many"][i].as_py())
            kept = np.add.reduceat(keep, _bounds(each)[:-1]).tolist() if len(each) else []
            rows.append((table["f"][i].as_py(), table["g"][i].as_py(), table["sids"][i].as_py(),
                         table["n"][i].as_py(), kept, _blob(p[keep]), _blob(mine[keep])))
        return pa.Table.from_batches([pack_rows(*zip(*rows))])

    def gather(table: pa.Table) -> pa.Table:
        names, sizes, docs, grams, ranks = {}, [], [], [], []
        for i in range(table.num_rows):
            sids, n = table["sids"][i].as_py(), table["n"][i].as_py()
            ids = []
            for s, m in zip(sids, n):
                if s not in names:
                    names[s] = len(names)
                    sizes.append(m)
                ids.append(names[s])
            docs.append(np.repeat(np.asarray(ids, np.int64), table["many"][i].as_py()))
            grams.append(np.frombuffer(table["grams"][i].as_py(), np.uint64))
            ranks.append(np.frombuffer(table["ranks"][i].as_py(), np.uint8))
        doc, gram, place = np.concatenate(docs), np.concatenate(grams), np.concatenate(ranks)
        order = np.lexsort((gram, place, doc))
        doc, gram = doc[order], gram[order]
        ends = np.searchsorted(doc, np.arange(len(names) + 1))
        out = {"sid": [], "n": [], "s": [], "marks": [], "prefix": [], "grams": []}
        for (sid, i), n in zip(names.items(), sizes):
            own = gram[ends[i]:ends[i + 1]]
            # N-grams of one set only come first in the order and take their places.
            long = n - -(-n * percent // 100) + 1 - (n - len(own))
            if long > 0:
                odd = np.bincount((buffers.stir(own) % np.uint64(64 * _WORDS)).astype(np.int64), minlength=64 * _WORDS) & 1
                marks = np.packbits(odd.astype(np.uint8)).view(np.int64)
                for c, v in zip(out, (sid, n, len(own), marks, own[:long].view(np.int64), _blob(np.sort(own)))):
                    out[c].append(v)
        return pa.table({"sid": pa.array(out["sid"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                         "s": pa.array(out["s"], pa.int64()),
                         "marks": pa.array(out["marks"], pa.list_(pa.int64())), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
                         "grams": pa.array(out["grams"], pa.binary())})

    tagged = sets.select("sid", "n", "grams", F.pmod(F.xxhash64("sid"), F.lit(groups)).cast("int").alias("g"))
    parts = tagged.mapInArrow(cut, schema).groupBy("f").applyInArrow(rank, schema)
    return cut_lineage(parts.groupBy("g").applyInArrow(
        gather, "sid bigint, n bigint, s bigint, marks array<bigint>, prefix array<bigint>, grams binary"))


def _linked(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity. Each fragment of the order counts its part
    of the overlap; a row holds one fragment of two documents."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _edges(FRAGMENTS, 1 << 64)
        for batch in batches:
            sid, n, f, part = [], [], [], []
            for s, m, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                grams = np.frombuffer(b, np.uint64)
                ends = np.concatenate([[0], np.searchsorted(grams, edge), [len(grams)]])
                for i in np.flatnonzero(np.diff(ends)):
                    sid.append(s)
                    n.append(m)
                    f.append(i)
                    part.append(_blob(grams[ends[i]:ends[i + 1]]))
            yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.int32()),
                                   pa.array(part, pa.binary())], names=["sid", "n", "f", "part"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                grams, rows = [], []
                for c in (4, 5):
                    data, offsets = buffers.texts(batch.column(c))
                    grams.append(np.frombuffer(data.tobytes(), np.uint64))
                    rows.append(np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8))
                gram, row = np.concatenate(grams), np.concatenate(rows)
                order = np.lexsort((gram, row))
                gram, row = gram[order], row[order]
                both = np.flatnonzero((gram[1:] == gram[:-1]) & (row[1:] == row[:-1]))
                common = np.bincount(row[both], minlength=batch.num_rows)
                yield pa.record_batch([*[batch.column(i) for i in range(4)], pa.array(common)],
                                      names=["a", "b", "n", "m", "common"])

    parts = ordered.select("sid", "n", "grams").mapInArrow(cut, "sid bigint, n bigint, f int, part binary")
    left = parts.select(F.col("sid").alias("a"), "n", "f", F.col("part").alias("x"))
    right = parts.select(F.col("sid").alias("b"), F.col("n").alias("m"), "f", F.col("part").alias("y"))
    joined = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "n", "m", "x", "y")
    counted = joined.mapInArrow(overlap, "a bigint, b bigint, n bigint, m bigint, common bigint").groupBy(
        "a", "b", "n", "m").agg(F.sum("common").alias("c"))
    return counted.filter(100 * F.col("c") >= percent * (F.col("n") + F.col("m") - F.col("c"))).select("a", "b")


def _connected(edges: DataFrame) -> DataFrame:
    """(sid, label): the smallest sid of each component, by alternating large and small
    stars (Kiveris et al.); neighbours are never gathered, only their minimum is."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(edges.select("e.u", "e.v").filter("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct())
        seen = state
