"""Pack tokenised documents into sequences of bounded length by best fit.

A task tokenises its documents and packs them as they come: a fixed number of open
bins, their free space kept as the bits of one integer, a piece goes where least
space is left over, and when no bin has room the fullest open one closes first.
Closed sequences are final. The pieces that remain in open bins, a bounded number
per task, are packed again in groups of about ``AGAIN_ROWS``, longest first and with
as many bins as they need, so small splits cost no space.

Defined cases: a null text counts as empty; a document longer than a sequence is cut
into full pieces, the first piece taking the remainder; a key may repeat or be null,
every row is packed; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anomalens.plans.storage import cut_lineage

SEQUENCE = 1024
OPEN_BINS = 64
# Pieces of open bins that one task packs again.
AGAIN_ROWS = 50_000
_CACHED = 300_000
_TASK = 1 << 31


class Bins:
    """Bounded-space best fit. ``place`` gives a bin and an offset in it."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.made, self.many = size, most, 0, 0
        self.free: dict[int, list[int]] = {}
        self.bits = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            name = self._take(room)
        else:
            if self.many >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            room, name = self.size, self.made
            self.made += 1
        if room > length:
            self.free.setdefault(room - length, []).append(name)
            self.bits |= 1 << (room - length)
            self.many += 1
        return name, self.size - room

    def _take(self, room: int) -> int:
        names = self.free[room]
        name = names.pop()
        self.many -= 1
        if not names:
            del self.free[room]
            self.bits &= ~(1 << room)
        return name

    def open(self) -> set[int]:
        return {name for names in self.free.values() for name in names}


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to those of the tokenizers
    library, which adds no special tokens. With ``added`` a literal added token in a
    text, such as an end mark, has its own id as there; else it is text like any other.

    Byte-level BPE works inside words, and for its pattern a text may be cut before
    every blank that a non-blank follows; the pieces repeat, so a bounded number of
    them is kept. If every merge makes a larger id than those before, ids are ranks
    and the faster library with the same merges is used for texts without added tokens.
    """

    PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

    def __init__(self, path: str, added: bool = False) -> None:
        import re

        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self._slow.encode_special_tokens = not added
        self._fast = self._ranked(path)
        self._cuts = re.compile(r" (?:\s|\Z)")
        # Added tokens that are no special ones are found whatever the flag says.
        tokens = [t for t in self._slow.get_added_tokens_decoder().values() if added or not t.special]
        if any(t.normalized for t in tokens):
            self._fast = None  # found in another form of the text
        self._added = re.compile("|".join(re.escape(t.content) for t in tokens)) if tokens else None
        self._kept: dict[str, bytes] = {}

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not spec.get("normalizer")
                 and not model.get("ignore_merges"))
        if not plain:
            return None
        ids = model["vocab"]
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(
            b for b in range(256) if b not in set(keep))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letter[c] for c in token): i for token, i in ids.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self._fast is None or self._added and self._added.search(text):
            return array("I", self._slow.encode(text, add_special_tokens=False).ids).tobytes()
        if self._cuts.search(text):
            return array("I", self._fast.encode_ordinary(text)).tobytes()
        kept, out = self._kept, []
        if len(kept) > _CACHED:
            kept.clear()
        first = True
        for word in text.split(" "):
            if not first:
                word = " " + word
            first = False
            ids = kept.get(word)
            if ids is None:
                ids = array("I", self._fast.encode_ordinary(word)).tobytes()
                if len(word) <= 32:
                    kept[word] = ids
            out.append(ids)
        return b"".join(out)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = 2,
         size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: the key, ``piece`` (from 0), ``start`` (ids of the document
    before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``sequence_id``
    and ``offset`` (place in the sequence). ``tokenizer`` is the path of a tokenizers
    file that the executors can read."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"k {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint, "
              "again boolean")
    closing = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, held = None, Bins(size, open_bins), {}
        for batch in batches:
            encode = encode or Encoder(tokenizer, added=True)
            out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids", "bin", "offset")}
            for i, x in enumerate(batch.column(1)):
                ids = encode(x.as_py() or "") + closing
                many = len(ids) // 4
                cut, piece, low = many % size or size, 0, 0
                while low < many:
                    name, offset = bins.place(cut - low)
                    for c, v in zip(out, (i, piece, low, cut - low, ids[4 * low:4 * cut], name, offset)):
                        out[c].append(v)
                    piece, low, cut = piece + 1, cut, cut + size
            yield from _rows(batch.column(0), out, False, held, bins)
        yield from _rows(None, None, True, held, bins)

    def _rows(keys, out, last, held, bins):
        # Rows leave once their bin is closed; those of open bins wait.
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() * _TASK
        names = ["k", "piece", "start", "length", "ids", "sequence_id", "offset", "again"]
        still = bins.open()
        if out is not None:
            table = pa.table({
                "k": keys.take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()),
                "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()),
                "ids": pa.array(out["ids"], pa.binary()), "bin": pa.array(out["bin"], pa.int64()),
                "offset": pa.array(out["offset"], pa.int64())})
            if held.get("rows") is not None:
                table = pa.concat_tables([held["rows"], table])
        else:
            table = held.get("rows")
        if table is None or not table.num_rows:
            return
        waits = np.isin(table["bin"].to_numpy(), np.fromiter(still, np.int64, len(still)))
        leave = table if last else table.filter(pa.array(~waits))
        held["rows"] = None if last else table.filter(pa.array(waits)).combine_chunks()
        if leave.num_rows:
            again = waits if last else np.zeros(leave.num_rows, bool)
            done = pa.table([leave["k"], leave["piece"], leave["start"], leave["length"], leave["ids"],
                             pa.array(leave["bin"].to_numpy() + base), leave["offset"], pa.array(again)], names=names)
            yield from done.combine_chunks().to_batches(max_chunksize=20_000)

    rows = cut_lineage(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema))
    again = rows.filter("again")
    groups = max(1, -(-again.count() // AGAIN_ROWS))

    def repack(table: pa.Table) -> pa.Table:
        group = table["g"][0].as_py()
        order = np.lexsort((table["offset"].to_numpy(), table["sequence_id"].to_numpy(), -table["length"].to_numpy()))
        bins, place = Bins(size, table.num_rows), {}
        for i in order:
            place[i] = bins.place(int(table["length"][int(i)].as_py()))
        put = [place[i] for i in range(table.num_rows)]
        base = -(group + 1) * _TASK
        return pa.table([table[c] for c in ("k", "piece", "start", "length", "ids")] + [
            pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64()),
            table["again"]], names=["k", "piece", "start", "length", "ids", "sequence_id", "offset", "again"])

    grouped = again.withColumn("g", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)))
    packed = rows.filter("NOT again").unionByName(grouped.groupBy("g").applyInArrow(repack, schema))
    return packed.drop("again").withColumnRenamed("k", key)
