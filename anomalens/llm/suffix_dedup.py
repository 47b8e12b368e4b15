"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is sorted only through its first ``window`` bytes: most-significant-digit
passes group suffixes by one digit after the other, a group of one document is left
alone, and the groups after the last pass are exactly the repeated windows.

The passes run over few suffixes. Every window has an anchor, the 16-byte gram in it
with the smallest hash (leftmost of equal ones), so equal windows have equal anchors at
the same place.

1. Each block of documents sends its distinct anchors, a few bytes each; anchors seen
   in one document only end here (the sort's first pass).
2. For every other anchor a block sends the bytes of the windows that belong to it,
   once per distinct stretch and with the smallest id that has it. Buckets of anchors
   sort the windows in three further passes and return which of them also start in a
   document with a smaller id. Equality is checked on the bytes.
3. Each block marks the bytes that these windows cover.

Texts are written once, as a table bucketed by block, so no later step moves them.
A passage that many documents share is sent once per block and pass.

Defined cases: a null text counts as empty; texts shorter than a window lose nothing;
a null id ranks before all others; of rows with equal ids none is smaller, so they take
nothing from each other; an empty table gives an empty result. Ids must be integers.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from anomalens.llm import buffers
from anomalens.llm.common import text_of
from anomalens.plans.storage import cut_lineage, scratch_path

WINDOW = 50
GRAM = 16
MOST_WINDOW = 63 + GRAM  # the windows of one anchor are the bits of a 64-bit number
BLOCK_BYTES, BLOCK_ROWS, MOST_BUCKETS = 4 << 20, 4096, 20_000
ANCHOR_BUCKET, SUFFIX_BUCKET = 16 << 20, 8 << 20  # bytes of text per bucket
_FIRST = np.iinfo(np.int64).min
_BITS = np.uint64((1 << 39) - 1)
_LEAST, _TOP = np.uint32(1), np.uint32(0xFFFFFFFE)
RESULT = "kept binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>"


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kept, n_bytes, spans): the bytes of each text that no window covers which
    also starts in a document with a smaller key, and the removed stretches."""
    if not 2 * GRAM <= window <= MOST_WINDOW:
        raise ValueError(f"the window must have {2 * GRAM} to {MOST_WINDOW} bytes")
    blocks, total = _blocks(docs, text, key)
    anchors = max(1, -(-total // ANCHOR_BUCKET))
    suffixes = max(1, -(-total // SUFFIX_BUCKET))
    sent = blocks.groupBy("block").applyInArrow(_send_anchors(window, anchors), "bucket int, block bigint, words binary")
    repeated = cut_lineage(sent.groupBy("bucket").applyInArrow(_repeated_anchors, "block bigint, bucket int, words binary"))
    schema = "bucket int, block bigint, kind int, entries binary"
    stretches = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(
        _send_stretches(window, anchors, suffixes), schema)
    marks = stretches.groupBy("bucket").applyInArrow(_sort_windows(window), schema)
    kind = docs.schema[key].dataType.simpleString()
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        _apply(window, key), f"`{key}` bigint, {RESULT}").withColumn(key, F.col(key).cast(kind))


def _blocks(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """(block, rid, id, text) as a bucketed table, and the bytes of all texts. The name
    in the catalog goes at once; the files stay in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("id"), text_of(text).cast("binary").alias("text"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    each = max(1, min(BLOCK_ROWS, BLOCK_BYTES * n // max(total, 1)))
    buckets = max(-(-n // each), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    name = f"anomalens_blocks_{uuid.uuid4().hex}"
    (rows.withColumn("block", F.floor(F.col("rid") / each)).write.bucketBy(min(buckets, MOST_BUCKETS), "block")
     .option("path", scratch_path(spark, "blocks")).format("parquet").saveAsTable(name))
    blocks = spark.table(name)
    blocks.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return blocks, int(total)


def _texts(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.take(pc.sort_indices(table["rid"])).combine_chunks()
    data, offsets = buffers.texts(table["text"])
    return table, data, offsets


def _spread(data: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest (largest) of ``width`` values from each position on."""
    done = 1
    while done < width:
        more = min(done, width - done)
        data = pick(data[:len(data) - more], data[more:])
        done += more
    return data


def anchors_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Position and 64-bit name of every anchor, and the first and last start of the
    windows that belong to it (none if last < first)."""
    found = [(part + offsets[a], *(x if i == 0 else x + offsets[a] for i, x in enumerate(rest)))
             for a, b in buffers.pieces(offsets, 1 << 18)
             for part, *rest in [_anchors(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], window)]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    n, reach = len(data), window - GRAM + 1
    at = buffers.eights(np.concatenate([data, np.zeros(GRAM, np.uint8)]))
    low, high = at[:n], at[8:n + 8]
    value = ((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)))
    value ^= value >> np.uint64(29)
    # 0 stands for no window, the value above _TOP for no gram.
    value = np.clip((value * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32), _LEAST, _TOP)
    value = np.concatenate([value, np.full(2 * reach, 0xFFFFFFFF, np.uint32)])
    starts, size = offsets[:-1], np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    long = size >= window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, offsets[1:][long] - window + 1, -1)
    inside = np.cumsum(inside[:n]) > 0  # starts of whole windows
    least = _spread(value, reach, np.minimum)[:n]
    least = np.concatenate([np.zeros(reach - 1, np.uint32), np.where(inside, least, 0)])
    best = _spread(least, reach, np.maximum)
    place = np.flatnonzero((best == value[:n]) & (best > 0))
    mine, doc = value[place], np.searchsorted(offsets, place, "right") - 1
    first = np.maximum(place - reach + 1, starts[doc])
    last = np.minimum(place, offsets[1:][doc] - window)
    # A window does not belong to an anchor if one before it is not larger, or one behind it is smaller.
    for step, worse in ((-1, np.less_equal), (1, np.less)):
        live, other = np.arange(len(place)), np.arange(len(place))
        while len(live):
            other = other + step
            ok = (other >= 0) & (other < len(place))
            live, other = live[ok], other[ok]
            near = np.abs(place[other] - place[live]) < reach
            live, other = live[near], other[near]
            hit = worse(mine[other], mine[live])
            if step < 0:
                first[live[hit]] = np.maximum(first[live[hit]], place[other[hit]] + 1)
            else:
                last[live[hit]] = np.minimum(last[live[hit]], place[other[hit]] - reach)
            live, other = live[~hit], other[~hit]
    return place, buffers.stir(buffers.stir(low[place]) ^ high[place]), first, last


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _five(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.reshape(-1).view("<u8")


def _send_anchors(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, data, offsets = _texts(table)
        place, name, first, last = anchors_of(data, offsets, window)
        owns = last >= first
        place, name = place[owns], name[owns]
        doc = np.searchsorted(offsets, place, "right") - 1
        part, word = _bucket(name, buckets), name & _BITS
        order = np.lexsort((word, part))
        part, word, doc = part[order], word[order], doc[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        several = np.zeros(len(word), bool)
        several[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        several = np.add.reduceat(several, head) > 0 if len(head) else np.zeros(0, bool)
        word = (word[head] << np.uint64(1)) | several.astype(np.uint64)
        ends = np.searchsorted(part[head], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(ends))
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block, np.int64)),
                         "words": pa.array([_five(word[ends[b]:ends[b + 1]]) for b in full], pa.binary())})
    return run


def _repeated_anchors(table: pa.Table) -> pa.Table:
    parts = [_unfive(w.as_py()) for w in table["words"]]
    words = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    word, several = words >> np.uint64(1), (words & np.uint64(1)).astype(bool)
    order = np.argsort(word, kind="stable")
    word, several, row = word[order], several[order], row[order]
    same = np.zeros(len(word) + 1, bool)
    same[1:-1] = word[1:] == word[:-1]
    hit = same[1:] | same[:-1] | several
    word, row = word[hit], row[hit]
    order = np.argsort(row, kind="stable")
    word, row = word[order], row[order]
    ends = np.searchsorted(row, np.arange(len(parts) + 1))
    full = np.flatnonzero(np.diff(ends))
    return pa.table({"block": table["block"].take(pa.array(full)), "bucket": table["bucket"].take(pa.array(full)),
                     "words": pa.array([_five(word[ends[i]:ends[i + 1]]) for i in full], pa.binary())})


_ENTRY = np.dtype([("id", "<i8"), ("doc", "<u4"), ("start", "<u4"), ("size", "u1")])
_MARK = np.dtype([("doc", "<u4"), ("start", "<u4"), ("which", "<u8")])
_STRETCH = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])
_SORT, _WHOLE, _SOME = 0, 1, 2


def _send_stretches(window: int, buckets: int, out_buckets: int):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        if table.num_rows and known.num_rows:
            block = table["block"][0].as_py()
            rows = _stretches(table, known, block)
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "block": pa.array([r[1] for r in rows], pa.int64()),
                         "kind": pa.array([r[2] for r in rows], pa.int32()),
                         "entries": pa.array([r[3] for r in rows], pa.binary())})

    def _stretches(table: pa.Table, known: pa.Table, block: int) -> list[tuple[int, int, int, bytes]]:
        table, data, offsets = _texts(table)
        ids = pc.fill_null(table["id"], _FIRST).to_numpy()
        place, name, first, last = anchors_of(data, offsets, window)
        wanted = np.sort(np.concatenate([(np.uint64(b.as_py()) << np.uint64(39)) | _unfive(w.as_py())
                                         for b, w in zip(known["bucket"], known["words"])]))
        tag = (_bucket(name, buckets).astype(np.uint64) << np.uint64(39)) | (name & _BITS)
        at = np.minimum(np.searchsorted(wanted, tag), len(wanted) - 1)
        use = (wanted[at] == tag) & (last >= first)
        place, name, first, last = place[use], name[use], first[use], last[use]
        doc = np.searchsorted(offsets, place, "right") - 1
        own, size = ids[doc], last - first + window
        # One row of bytes per stretch, zeros behind its end, and the anchor's place in it.
        full = -(-(2 * window - GRAM + 1) // 8) * 8
        bytes_ = np.concatenate([data, np.zeros(full, np.uint8)])
        stretch = np.lib.stride_tricks.sliding_window_view(bytes_, full)[first].copy()
        stretch[np.arange(full) >= size[:, None]] = 0
        wide = stretch.view(np.uint64)
        h = (size * 256 + place - first).astype(np.uint64)
        for j in range(wide.shape[1]):
            h = buffers.stir(h ^ wide[:, j])
        order = np.lexsort((own, h))
        h, wide, own_ = h[order], wide[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1])
        head = np.flatnonzero(new)
        lead = np.repeat(head, np.diff(np.append(head, len(h))))
        # Behind a stretch of a smaller id in the same block: all its windows are repeats.
        gone = (own_ > own_[lead]) & (wide == wide[lead]).all(axis=1) & (size[order] == size[order][lead])
        mine = order[gone]
        rows = []
        if len(mine):
            out = np.empty(len(mine), _STRETCH)
            out["doc"], out["start"] = doc[mine], first[mine] - offsets[doc[mine]]
            out["end"] = out["start"] + size[mine]
            rows.append((block % out_buckets, block, _WHOLE, out.tobytes()))
        mine = order[~gone]
        part = _bucket(name[mine], out_buckets)
        mine = mine[np.argsort(part, kind="stable")]
        ends = np.searchsorted(np.sort(part), np.arange(out_buckets + 1))
        press = zstandard.ZstdCompressor(level=1)
        for b in np.flatnonzero(np.diff(ends)):
            some = mine[ends[b]:ends[b + 1]]
            out = np.empty(len(some), _ENTRY)
            out["id"], out["doc"] = own[some], doc[some]
            out["start"], out["size"] = first[some] - offsets[doc[some]], size[some]
            used = np.arange(full) < size[some][:, None]
            body = out.tobytes() + stretch[some][used].tobytes()
            rows.append((int(b), block, _SORT, len(some).to_bytes(4, "little") + press.compress(body)))
        return rows
    return run


def _sort_windows(window: int):
    full = -(-(2 * window - GRAM + 1) // 8) * 8
    digits = ((0, 16), (16, 32), (32, window))

    def run(table: pa.Table) -> pa.Table:
        sort = pc.equal(table["kind"], _SORT)
        ready, table = table.filter(pc.invert(sort)), table.filter(sort)
        if not table.num_rows:
            return ready
        entries, stretches, press = [], [], zstandard.ZstdDecompressor()
        for blob in table["entries"]:
            blob = blob.as_py()
            n = int.from_bytes(blob[:4], "little")
            body = press.decompress(blob[4:])
            head = np.frombuffer(body, _ENTRY, n)
            filled = np.zeros((n, full), np.uint8)
            filled[np.arange(full) < head["size"][:, None]] = np.frombuffer(body, np.uint8, offset=n * _ENTRY.itemsize)
            entries.append(head)
            stretches.append(filled)
        row = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
        entry = np.concatenate(entries)
        which = repeats(np.concatenate(stretches), entry["size"].astype(np.int64), entry["id"], window, digits)
        hit = np.flatnonzero(which)
        out = np.empty(len(hit), _MARK)
        out["doc"], out["start"], out["which"] = entry["doc"][hit], entry["start"][hit], which[hit]
        ends = np.searchsorted(row[hit], np.arange(len(entries) + 1))
        some = np.flatnonzero(np.diff(ends))
        marks = pa.table({"bucket": table["bucket"].take(pa.array(some)), "block": table["block"].take(pa.array(some)),
                          "kind": pa.array(np.full(len(some), _SOME, np.int32)),
                          "entries": pa.array([out[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())},
                         schema=ready.schema)
        return pa.concat_tables([ready, marks])
    return run


def repeats(stretches: np.ndarray, size: np.ndarray, ids: np.ndarray, window: int, digits) -> np.ndarray:
    """For each stretch, as bits, its windows that also occur with a smaller id."""
    full = stretches.shape[1]
    many = size - window + 1
    entry = np.repeat(np.arange(len(size)), many)
    shift = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    at = buffers.eights(stretches.reshape(-1))
    base, own = entry * full + shift, ids[entry]
    live = np.arange(len(entry))
    group = np.zeros(len(entry), np.uint64)
    lead = live
    for low, high in digits:
        h = group
        for j in [*range(low, high - 7, 8), *([high - 8] if (high - low) % 8 else [])]:
            h = buffers.stir(h ^ at[base[live] + j])
        order = np.argsort(h, kind="stable")
        h, live = h[order], live[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(head):
            return np.zeros(len(size), np.uint64)
        count = np.diff(np.append(head, len(h)))
        least, most = np.minimum.reduceat(own[live], head), np.maximum.reduceat(own[live], head)
        # A group of one document is done: nothing in it repeats.
        on = np.repeat(least < most, count)
        number = np.repeat(np.arange(len(head), dtype=np.uint64), count)
        least = np.repeat(least, count)
        live, group, least = live[on], number[on], least[on]
    if not len(live):
        return np.zeros(len(size), np.uint64)
    # The first window of the smallest id stands for its group; equality is of bytes.
    order = np.lexsort((own[live], group))
    live, group = live[order], group[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lead = np.repeat(live[head], np.diff(np.append(head, len(live))))
    same = own[live] > own[lead]
    for j in [*range(0, window - 7, 8), window - 8]:
        same &= at[base[live] + j] == at[base[lead] + j]
    live = live[same]
    found = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(found, entry[live], np.uint64(1) << shift[live].astype(np.uint64))
    return found


def _apply(window: int, key: str):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = [key, "kept", "n_bytes", "spans"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), spans)], names=names)
        table, data, offsets = _texts(table)
        cover = np.zeros(len(data) + 1, np.int32)
        for kind, blob in zip(marks["kind"].to_pylist(), marks["entries"]):
            if kind == _WHOLE:
                found = np.frombuffer(blob.as_py(), _STRETCH)
                low, high = (offsets[found["doc"]] + found[c] for c in ("start", "end"))
            else:
                found = np.frombuffer(blob.as_py(), _MARK)
                bits = (found["which"][:, None] >> np.arange(window - GRAM + 1, dtype=np.uint64)) & np.uint64(1)
                entry, shift = np.nonzero(bits)
                low = offsets[found["doc"][entry]] + found["start"][entry] + shift
                high = low + window
            np.add.at(cover, low, 1)
            np.add.at(cover, high, -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        edge = np.zeros(len(data) + 1, bool)  # a run starts, or ends, before this byte
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        low, high = cuts[:-1], cuts[1:]
        run_ = gone[low] if len(low) else np.zeros(0, bool)
        low, high = low[run_], high[run_]
        doc = np.searchsorted(offsets, low, "right") - 1
        many = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])
        pairs = pa.StructArray.from_arrays([pa.array(low - offsets[doc]), pa.array(high - offsets[doc])],
                                           ["start", "end"])
        rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kept) - 1, [
            None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
        return pa.table([table["id"], rest, pa.array(np.diff(offsets)),
                         pa.ListArray.from_arrays(pa.array(many, pa.int32()), pairs).cast(spans)], names=names)
    return run
