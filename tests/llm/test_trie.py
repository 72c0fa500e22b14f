"""The conversation trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sparkcurate.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, root int, id string, `a.b` int"


def _conversations(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def _rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def _brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (
            members[x][0],
            len(x),
            members[x[:-1]][0] if x else -1,
            len(members[x]),
            len(children[x]),
            leaves[x],
            saved[x],
            hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest(),
        )
        for x in members
    )


def _table(spark, rows, n=5):
    return spark.createDataFrame([(*r, "p", 1, "i", 2) for r in rows], SCHEMA).repartition(n)


def _nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = []
    for c in [*range(0, 60), 100, 101, 150, 199, 250, 251, 299, 1234567]:
        for t in range(rnd.choice([0, 1, 2, 3, 6, 9])):
            out.append((c, t, rnd.choice(["user", "user", None, "bot"]), rnd.choice(["hi", "hi", "yes", "", None, "naïve 😀", "x" * 50])))
    copies = [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(8)]
    prefixes = [(c, t, "user", f"turn {t}") for c in range(400, 420) for t in range(c - 400)]
    odd = [(None, 1, "user", "lost"), (500, None, "b", "z"), (500, None, "a", "z"), (500, 2, "a", "z"), (500, 2, "a", "z"), (600, 5, "user", "only")]
    return out + copies + prefixes + odd


@pytest.fixture
def cut(monkeypatch):
    def to(layer, shard, blob=trie.BLOB):
        monkeypatch.setattr(trie, "LAYER", layer)
        monkeypatch.setattr(trie, "SHARD_IDS", shard)
        monkeypatch.setattr(trie, "BLOB", blob)

    return to


def _made(spark, rows):
    turns, ids = trie.rebuilt(trie.numbered(_table(spark, rows)))
    return trie.prefix_trie(turns, ids)


@pytest.mark.parametrize("layer,shard,blob", [(trie.LAYER, trie.SHARD_IDS, trie.BLOB), (trie.LAYER, 7, 10), (3, 6, 10), (1, 1, 1)])
def test_nodes(spark, rows, cut, layer, shard, blob):
    """One shard and many, whose borders cut common prefixes; one layer and many."""
    cut(layer, shard, blob)
    assert _nodes(_made(spark, rows)) == _brute(_rebuilt(_conversations(rows)))


def test_long_conversation_and_its_copies(spark, cut):
    """Most rows in a few conversations: more ids than a layer or a shard takes."""
    cut(50, 120)
    rows = [(c, t, "user", f"turn {t % 7}") for c in (1, 2) for t in range(230)]
    rows += [(3, t, "user", f"turn {t % 7}") for t in range(120)] + [(4, t, "user", f"turn {t % 7}" if t < 105 else "off") for t in range(150)]
    rows += [(c, 0, "user", "turn 0") for c in range(5, 30)]
    assert _nodes(_made(spark, rows)) == _brute(_rebuilt(_conversations(rows)))


def test_members_of_a_hot_end(spark, cut):
    cut(trie.LAYER, trie.SHARD_IDS, 40)
    members = spark.range(0, 3000).selectExpr("if(id % 3 = 0, 'hot', concat('p', id % 5)) AS piece", "id * 7 - 100 AS conv_id").repartition(9)
    want = defaultdict(list)
    for i in range(3000):
        want["hot" if i % 3 == 0 else f"p{i % 5}"].append(i * 7 - 100)
    got = {r.piece: r.ends_sha256 for r in trie.members_sha256(members).collect()}
    assert got == {p: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest() for p, m in want.items()}


def test_empty_table(spark, rows):
    assert _nodes(_made(spark, [])) == []
    assert _nodes(_made(spark, [(None, 1, "user", "lost")])) == []


def test_tree_is_balanced():
    shard = trie.Shard()
    for i in range(1023):
        shard.add({"root": "", "ids": [i], "sizes": [1], "top_conv_id": None})
    shard.grow()

    def height(at):
        return 0 if at < 0 else 1 + max(height(shard.low[at]), height(shard.high[at]))

    assert height(shard.down[0]) == 10
