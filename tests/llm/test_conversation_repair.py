"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from anomalens.llm import conversation_repair as C
from anomalens.llm import queries

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def key(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role[:16], text[:64],
            hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def cheapest(rows):
    """(cost, audit, rows): by trying every edit, layer by layer, whole audits kept."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by the initials so far, cut to what matters

    def put(into, shape, entry):
        shape = shape if len(shape) < 2 else shape[:1] + "…" + shape[-1]
        if shape not in into or entry[:2] < into[shape][:2]:
            into[shape] = entry

    def inserted(layer):
        for _ in range(2):
            new = dict(layer)
            for shape, (cost, audit, out) in layer.items():
                nxt = "assistant" if shape.endswith("u") else "user"
                put(new, shape + nxt[0], (cost + 5, audit + "I", out + ((nxt, ""),)))
            layer = new
        return layer
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for shape, (cost, audit, out) in inserted(best).items():
            put(new, shape, (cost + 2, audit + "D", out))
            if fault in "bd" and fault:
                continue
            more = 5 if fault == "t" else 0
            for edit, r, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                after = (shape[-1:] or "^") + r[:1]
                if after in ("^s", "^u", "su", "ua", "au"):
                    put(new, shape + r[:1], (cost + more + price, audit + edit, out + ((r, text),)))
        best = new
    ends = [e for shape, e in inserted(best).items() if shape == "" or shape.endswith("a")]
    cost, audit, out = min(ends, key=lambda e: e[:2])
    return cost, audit, out, faults


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and r[2] is not None), key=key)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, repaired, faults = cheapest(mine)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), illegal, cost, audit, sha)
    return out


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(r.randrange(1, longest)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 5, None]), r.choice(
                ["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                r.choice([None, "", " \n", "Yes.", "no", "Why?\t", "One two!", f"t{turn}.", f"t{turn}", "é…"])))
    return rows


def report(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query(spark, tmp_path):
    rows = made(1, 200, 12) + [(10 ** 6 + i, i, "user", "Ok.") for i in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    gone = {r[0] for r in rows}
    want = brute(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(got) == {c: want.get(c, empty) for c in gone} and len(gone - set(want)) > 0


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_chunks(spark, monkeypatch, chunk):
    """A conversation cut into chunks over many tasks is repaired like a whole one."""
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    rows = made(2, 6, 8) + [r for r in made(3, 1, 600) if r[0] == 0] + [(7, 1, "user", "Same.")] * 300
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = C.repair(df)
    assert report(got) == brute(rows)
    # The rows themselves, by the audit.
    shown = {}
    for r in C.repaired(df, got).orderBy("position").collect():
        shown.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in {r[0] for r in rows}:
        assert tuple(shown.get(conv, ())) == cheapest(sorted((r for r in rows if r[0] == conv), key=key))[2]


def test_edges(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(5, 1, "user", "x", "", 0), (None, None, None, None, "", 1)], SCHEMA)
    sha = hashlib.sha256(b"").hexdigest()
    assert report(C.repair(none, copies="copies")) == {5: (0, 0, 0, 0, 0, 0, "", sha), None: (0, 1, 0, 0, 0, 2, "D", sha)}
    long = spark.createDataFrame([(1, 1, "user", "a" * 2_000_000 + ".", "", 1), (1, 2, "assistant", "b" * 2_000_000 + ".", "", 1)], SCHEMA)
    assert report(C.repair(long))[1][5:7] == (0, "KK")


def _strings(n, seed):
    r = random.Random(seed)
    root = C.Node(None, "")
    nodes = [(root, "")]
    for _ in range(n):
        node, text = r.choice(nodes[-6:])
        piece = r.choice(["K", "D", "I", "R", "KD", "DD", "KK"])
        nodes.append((node.child(piece), text + piece))
    return nodes


@pytest.mark.parametrize("colliding", [False, True])
def test_nodes(monkeypatch, colliding):
    if colliding:  # a hash that tells nothing apart: the letters still decide
        monkeypatch.setattr(C, "_extended", lambda value, text: 0)
    nodes = _strings(120, 4)
    for (a, x), (b, y) in itertools.product(nodes, nodes):
        if colliding and x == y:
            continue
        want = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert C.common_prefix(a, b) == want and C.before(a, b) == (x < y)
        assert C._letters(a, 0, a.size) == x
