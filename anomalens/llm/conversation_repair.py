"""Repair of the structure of conversations by a persistent audit DP.

A sound conversation reads ``(s?(ua)+)?`` by the initials of its roles. Rows are kept
(cost 0), reroled (1) or deleted (2), empty ones are inserted (5), and a truncated row
that is not deleted adds 5. The audit is the string of the initials of the cheapest
edits (K, R, D, I), of equally cheap ones the least.

The DP has four states: nothing yet, after s, after u, after a. A state holds its cost
and a node of a tree of audits: nodes share their prefixes, know their ancestors 1, 2,
4, ... nodes up and a rolling hash of the string from the root. Where costs tie, the
longest common prefix is searched over the hashes and the next letter decides; the
letters behind the last shared node are compared, so a collision cannot decide.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is
spread over tasks. What a task sees whole is finished there. Of a conversation that
reaches beyond a task, or beyond ``CHUNK_ROWS`` rows or ``CHUNK_CHARS`` characters, every chunk becomes a table of
16 costs and audits (from each state to each state); the tables are put together in
order by the same nodes, now with a string each. Only the digest of a repaired
conversation has to stream through one task, because SHA-256 is a chain; no task holds
more than a chunk of rows, and the audit of one conversation.

Equal rows of a turn travel as one row with a count, and first occurrences come from a
map-side combined minimum, so copies are no burden.

Defined cases: a null role or text is one space; null turns come first; rows of one
turn are in the order of role and text (by their first 16 and 64 characters, then by a
digest of both); null conversation ids are one conversation; a conversation without
rows has zeros, an empty audit and the digest of nothing; an empty role is not legal
anywhere and can only be reroled or deleted; extra columns do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.plans.storage import cut_lineage

CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 23
_BLANKS = " \t\n\x0b\x0c\r"
_ROLE_PREFIX, _TEXT_PREFIX = 16, 64

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The one role that may be
# inserted (or given) next, and the state after it.
_NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_REROLE, _DELETE, _INSERT, _TRUNCATED = 1, 2, 5, 5

_BASE, _PRIME = 911_382_323, (1 << 61) - 1


class Node:
    """The end of an audit: a piece of text after the parent's."""

    __slots__ = ("up", "text", "size", "hash")

    def __init__(self, parent: Node | None, text: str):
        self.text = text
        if parent is None:
            self.up, self.size, self.hash = (), 0, 0
            return
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)
        self.size = parent.size + len(text)
        self.hash = _extended(parent.hash, text)

    def child(self, text: str) -> Node:
        return Node(self, text) if text else self


def _extended(value: int, text: str) -> int:
    for c in text:
        value = (value * _BASE + ord(c)) % _PRIME
    return value


def _holder(node: Node, size: int) -> Node:
    """The nearest to the root of node and its ancestors that has ``size`` letters."""
    while True:
        for a in reversed(node.up):
            if a.size >= size:
                node = a
                break
        else:
            return node


def _prefix_hash(node: Node, size: int) -> int:
    if not size:
        return 0
    node = _holder(node, size)
    if node.size == size:
        return node.hash
    parent = node.up[0]
    return _extended(parent.hash, node.text[:size - parent.size])


def _shared(a: Node, b: Node) -> Node:
    """The last node that both have, itself included."""
    def depth(n: Node) -> int:
        d = 0
        while n.up:
            d += 1 << (len(n.up) - 1)
            n = n.up[-1]
        return d
    da, db = depth(a), depth(b)
    if da < db:
        a, b, da, db = b, a, db, da
    rest, k = da - db, 0
    while rest:
        if rest & 1:
            a = a.up[k]
        rest, k = rest >> 1, k + 1
    if a is b:
        return a
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k] is not b.up[k]:
            a, b = a.up[k], b.up[k]
    return a.up[0]


def _letters(node: Node, start: int, end: int) -> str:
    if end <= start:
        return ""
    node, parts = _holder(node, end), []
    while node.size > start:
        parts.append(node.text)
        node = node.up[0]
    text = "".join(reversed(parts))
    return text[start - node.size:end - node.size]


def common_prefix(a: Node, b: Node) -> int:
    """Length of the longest common prefix of two audits."""
    shared = _shared(a, b).size
    low, high = shared, min(a.size, b.size)
    while low < high:
        mid = (low + high + 1) // 2
        if _prefix_hash(a, mid) == _prefix_hash(b, mid):
            low = mid
        else:
            high = mid - 1
    # Equal hashes may be a collision: the letters that are not shared are looked at.
    x, y = _letters(a, shared, low), _letters(b, shared, low)
    if x != y:
        return shared + next(i for i, (p, q) in enumerate(zip(x, y)) if p != q)
    return low


def before(a: Node, b: Node) -> bool:
    """Whether the audit of a is less than that of b."""
    n = common_prefix(a, b)
    if n == min(a.size, b.size):
        return a.size < b.size
    return _letters(a, n, n + 1) < _letters(b, n, n + 1)


# A layer: (cost, node) or None for every state.

def _better(layer: list, state: int, cost: int, node: Node, text: str) -> None:
    have = layer[state]
    if have is None or cost < have[0]:
        layer[state] = (cost, node.child(text))
    elif cost == have[0]:
        new = node.child(text)
        if before(new, have[1]):
            layer[state] = (cost, new)


def _with_inserts(layer: list) -> list:
    """Up to two rows inserted; more would lead to a state that is cheaper otherwise."""
    out = list(layer)
    for state, at in enumerate(layer):
        if at is not None:
            one = _NEXT[state][1]
            _better(out, one, at[0] + _INSERT, at[1], "I")
            if state < 2:
                _better(out, _NEXT[one][1], at[0] + 2 * _INSERT, at[1], "II")
    return out


def advance(layer: list, rows: Iterator[tuple[str, int, bool]]) -> list:
    """The layer after rows of (initial, forced deletions, truncated): an initial of
    None stands for forced deletions alone, else they follow the row."""
    for initial, forced, truncated in rows:
        if initial is not None:
            more = _TRUNCATED if truncated else 0
            # An insertion before a deletion could as well, and in lesser order, follow it.
            new = [None if at is None else (at[0] + _DELETE, at[1].child("D")) for at in layer]
            for state, at in enumerate(_with_inserts(layer)):
                if at is not None:
                    kept = _KEEP[state].get(initial)
                    if kept is not None:
                        _better(new, kept, at[0] + more, at[1], "K")
                    _better(new, _NEXT[state][1], at[0] + more + _REROLE, at[1], "R")
            layer = new
        if forced:
            layer = [None if at is None else (at[0] + _DELETE * forced, at[1].child("D" * forced)) for at in layer]
    return layer


def finish(layer: list) -> tuple[int, str]:
    """Cost and audit of the cheapest end."""
    ends = [at for state, at in enumerate(_with_inserts(layer)) if state in _ENDS and at is not None]
    cost, node = ends[0]
    for c, n in ends[1:]:
        if c < cost or c == cost and before(n, node):
            cost, node = c, n
    return cost, _letters(node, 0, node.size)


def start(state: int = 0) -> list:
    return [(0, Node(None, "")) if s == state else None for s in range(4)]


def apply_audit(audit: Iterator[str], rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its audit and its rows of (role,
    text, copies)."""
    state = 0
    for role, text, copies in rows:
        for _ in range(copies):
            letter = next(audit)
            while letter == "I":
                yield _NEXT[state][0], ""
                state = _NEXT[state][1]
                letter = next(audit)
            if letter == "K":
                yield role, text
                state = _KEEP[state][role[0]]
            elif letter == "R":
                yield _NEXT[state][0], text
                state = _NEXT[state][1]
    for _ in audit:
        yield _NEXT[state][0], ""
        state = _NEXT[state][1]


class _Digest:
    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False


# What is known of a stretch of a conversation, beside its costs.

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


class Stretch:
    """Rows in order, added one by one: counts, and steps for the DP."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.steps, self.rows = [], []
        self.first = self.last = self.least = self.most = None
        self.turns = self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, is_first: bool) -> None:
        initial, body = role[:1], text.rstrip(_BLANKS)
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        c = self.counts
        c["illegal"] += copies - 1
        if self.last is not None and self.last + initial not in _LEGAL:
            c["illegal"] += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if not body:
            c["blank"] += copies
            self.steps.append((None, copies, False))
        elif not is_first:
            c["duplicate"] += copies
            self.steps.append((None, copies, False))
        else:
            cut = body[-1] not in ".!?"
            c["truncated"] += cut
            c["duplicate"] += copies - 1
            self.steps.append((initial, copies - 1, cut))
        self.rows.append((role, text, copies))
        self.chars += len(text)

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


_KEYS = ("turn", "role_prefix", "text_prefix", "digest")
_PATHS = "array<struct<entry int, exit int, cost bigint, audit string>>"
_STRETCH = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, least bigint, "
            "most bigint, turns bigint")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "role_prefix": F.substring("role", 1, _ROLE_PREFIX), "text_prefix": F.substring("text", 1, _TEXT_PREFIX),
        "digest": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))})


def _in_order(rows: DataFrame) -> DataFrame:
    """Equal rows as one with a count, their order's keys, and before the first row of
    a role and text in a conversation a mark."""
    equal = _keyed(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    firsts = _keyed(rows.filter("copies > 0")).groupBy("conv", "role_prefix", "text_prefix", "digest").agg(
        F.min(F.struct("turn")).alias("at")).select(
            "conv", F.col("at.turn").alias("turn"), "role_prefix", "text_prefix", "digest", F.lit(0).alias("mark"))
    return firsts.unionByName(equal.withColumn("mark", F.lit(1)), allowMissingColumns=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish the conversations that lie within the task, sum up chunks of the others."""
    out, nothing = [], object()
    conv, open_, stretch, key, mark = nothing, True, Stretch(), None, None

    def close(whole: bool) -> None:
        row = {"conv": conv, "done": whole, **stretch.counts, "first": stretch.first, "last": stretch.last,
               "least": stretch.least, "most": stretch.most, "turns": stretch.turns,
               **dict(zip(_KEYS, key or (None,) * len(_KEYS)))}
        if whole:
            row["cost"], row["audit"] = finish(advance(start(), stretch.steps))
            digest = _Digest()
            for role, text in apply_audit(iter(row["audit"]), stretch.rows):
                digest.add(role, text)
            row["sha"] = digest.hash.hexdigest()
        else:
            row["paths"] = [{"entry": s, "exit": t, "cost": at[0], "audit": _letters(at[1], 0, at[1].size)}
                            for s in range(4) for t, at in enumerate(advance(start(s), stretch.steps)) if at is not None]
        out.append(row)

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, schema=_scan_schema(conv_type))
        out.clear()
        return batch
    conv_type = pa.int64()
    for batch in batches:
        conv_type = batch.schema.field("conv").type
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist()
                   for n in ("conv", "turn", "role", "text", "copies", "role_prefix", "text_prefix", "digest", "mark")]
        for c, turn, role, text, copies, role_prefix, text_prefix, digest, is_row in zip(*columns):
            if c != conv or conv is nothing:
                if conv is not nothing:
                    close(not open_)
                open_ = conv is nothing  # the first one may have begun in the task before
                conv, stretch, key, mark = c, Stretch(), None, None
            at = (turn, role_prefix, text_prefix, digest)
            if not is_row:
                mark = at
            elif copies:
                if len(stretch.steps) >= CHUNK_ROWS or stretch.chars >= CHUNK_CHARS:
                    open_ = True
                    close(False)
                    stretch, key = Stretch(), None
                key = key or at
                stretch.add(turn, role, text, copies, at == mark)
        if len(out) >= 4096:
            yield flushed()
    if conv is not nothing:
        close(False)  # may go on in the next task
    if out:
        yield flushed()


def _scan_schema(conv: pa.DataType) -> pa.Schema:
    path = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([
        ("conv", conv), ("done", pa.bool_()), *[(n, pa.int64()) for n in _COUNTS], ("first", pa.string()),
        ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("turn", pa.int64()),
        ("role_prefix", pa.string()), ("text_prefix", pa.string()), ("digest", pa.binary()), ("paths", pa.list_(path)),
        ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the chunks of each conversation together; they come in order."""
    nothing = object()
    conv, whole, layer = nothing, None, None

    def result() -> pa.RecordBatch:
        cost, audit = finish(layer)
        row = {"conv": conv, "gaps": whole.gaps(), **whole.counts, "cost": cost, "audit": audit}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(
            [("conv", kind), ("gaps", pa.int64()), *[(n, pa.int64()) for n in _COUNTS], ("cost", pa.int64()), ("audit", pa.string())]))
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv").type
        for r in batch.to_pylist():
            if r["conv"] != conv or conv is nothing:
                if conv is not nothing:
                    yield result()
                conv, whole, layer = r["conv"], Stretch(), start()
            for n in _COUNTS:
                whole.counts[n] += r[n]
            if r["first"] is not None:
                if whole.last is not None and whole.last + r["first"] not in _LEGAL:
                    whole.counts["illegal"] += 1
                whole.last = r["last"]
            if r["least"] is not None:
                whole.turns += r["turns"] - (whole.most == r["least"])
                whole.least = r["least"] if whole.least is None else whole.least
                whole.most = r["most"]
            new = [None] * 4
            for p in r["paths"]:
                at = layer[p["entry"]]
                if at is not None:
                    _better(new, p["exit"], at[0] + p["cost"], at[1], p["audit"])
            layer = new
    if conv is not nothing:
        yield result()


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, in one task each."""
    both = audits.select("conv", "audit", F.lit(0).alias("mark")).unionByName(
        rows.withColumn("mark", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "mark", *_KEYS).select(
        "conv", "audit", "role", "text", "copies", "mark")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, iterator of its repaired rows); each is used up before the next."""
    def flat():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])
    rows, held = flat(), []

    def body():
        for r in rows:
            if not r[5]:
                held.append(r)
                return
            if r[4]:
                yield r[2], r[3], r[4]
    head = next(rows, None)
    while head is not None:
        mine = body()
        yield head[0], apply_audit(iter(head[1]), mine)
        for _ in mine:
            pass
        head = held.pop() if held else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, batches = _peeked(batches)
    for conv, repaired in _conversations(batches):
        digest = _Digest()
        for role, text in repaired:
            digest.add(role, text)
        yield pa.record_batch([pa.array([conv], kind), pa.array([digest.hash.hexdigest()])], names=["conv", "sha"])


def _peeked(batches: Iterator[pa.RecordBatch]):
    first = next(batches, None)
    if first is None:
        return pa.int64(), iter(())

    def again():
        yield first
        yield from batches
    return first.schema.field("conv").type, again()


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, batches = _peeked(batches)
    out, chars = [], 0

    def flushed() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()),
                                 pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())],
                                names=["conv", "position", "role", "text"])
        out.clear()
        return batch
    for conv, repaired in _conversations(batches):
        for position, (role, text) in enumerate(repaired):
            out.append((conv, position, role, text))
            chars += len(text)
            if len(out) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                yield flushed()
                chars = 0
    if out:
        yield flushed()


def _plain(conversations: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    n = F.col(f"`{copies}`").cast("bigint") if copies else F.lit(1).cast("bigint")

    def there(c: Column) -> Column:
        return F.when(n > 0, c)
    return conversations.select(
        F.col(f"`{conv}`").alias("conv"), there(F.col(f"`{turn}`").cast("bigint")).alias("turn"),
        there(F.coalesce(F.col(f"`{role}`"), F.lit(" "))).alias("role"),
        there(F.coalesce(F.col(f"`{text}`"), F.lit(" "))).alias("text"), n.alias("copies"))


def _of(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Equal rows as one, with their keys, of some conversations only."""
    some = some.select(F.col("conv").alias("_c"))
    rows = rows.join(some, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    return _keyed(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None) -> DataFrame:
    """Per conversation its id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256. ``copies`` names a column that says how often a row stands
    there; a conversation whose rows all have 0 is one without rows."""
    rows = _plain(conversations, conv, turn, role, text, copies)
    kind = rows.schema["conv"].dataType.simpleString()
    order = ("conv", *_KEYS)
    dealt = _in_order(rows).repartitionByRange(*order).sortWithinPartitions(*order, "mark")
    found = cut_lineage(dealt.mapInArrow(
        _scan, f"conv {kind}, done boolean, {_STRETCH}, turn bigint, role_prefix string, text_prefix string, digest binary, "
               f"paths {_PATHS}, cost bigint, audit string, sha string"))
    closed = found.filter("done").select(
        "conv", F.when(F.col("least").isNull(), 0).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns")).alias("gaps"),
        *_COUNTS, "cost", "audit", "sha")
    parts = found.filter("not done").drop("done", "cost", "audit", "sha")
    audits = cut_lineage(parts.repartition("conv").sortWithinPartitions("conv", *_KEYS).mapInArrow(
        _fold, f"conv {kind}, {_REPORT}"))
    digests = _streamed(_of(rows, audits), audits).mapInArrow(_digests, f"conv {kind}, sha string").withColumnRenamed("conv", "_c")
    opened = audits.join(digests, F.col("conv").eqNullSafe(F.col("_c"))).select(*closed.columns)
    return closed.unionByName(opened).select(
        F.col("conv").alias(conv), "gaps", *_COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired(conversations: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv, position, role, text): the rows of the repaired conversations, by the
    audits that ``repair`` reported of the same rows."""
    rows = _plain(conversations, conv, turn, role, text, copies)
    kind = rows.schema["conv"].dataType.simpleString()
    audits = report.select(F.col(f"`{conv}`").alias("conv"), "audit")
    out = _streamed(_of(rows, audits), audits).mapInArrow(
        _repaired_rows, f"conv {kind}, position bigint, role string, text string")
    return out.withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The rows with faults put in by the CRC-32 of ``conversation:turn`` modulo 20
    (0 drops, 1 empties, 2 takes sentence marks out, 3 repeats, 4 makes it a user's);
    ``copies`` says how often a row stands there."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(given(conv), F.lit(":"), given(turn)).cast("binary")) % 20
    return conversations.select(
        F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn),
        F.when(fault == 4, F.lit("user")).otherwise(given(role)).alias(role),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(given(text), ".!?", "")).otherwise(given(text)).alias(text),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
