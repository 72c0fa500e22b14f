"""Prefix trie of conversations.

Turns are dictionary-encoded; a conversation is the list of its turn ids, cut into pieces of
``LAYER`` ids, so no row grows with a conversation. Pieces below the same node (``root``) form one
trie. Equal pieces are one row with a count.

1. Distinct pieces are sorted by (root, ids) over range partitions. A task puts every few hundred
   thousand ids, a range shard, into ternary search trees: the sorted pieces are inserted median first,
   which balances the tree of siblings at every node. Nodes lie in arrays in the order they were made,
   parents before children, so one backward pass adds up members, leaves and savings.
2. Only nodes on the first or the last path of a shard can also be in another. They carry a hash of
   their path and are merged by it. What two neighbours both counted is the common prefix of the last
   piece of one and the first of the next; it is taken off by one row per node of it.
3. Layers run from the deepest up: the totals of a trie go to the node of the layer above that it hangs
   from. Conversations of up to ``LAYER`` turns have one layer.

The smallest member names a node together with its depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.operators.ranking import rank_rows
from sparkcurate.session import materialise

LAYER = 4096
SHARD_IDS = 200_000
BLOB = 4096  # characters of a piece of a list of members
NO_ENDS = hashlib.sha256(b"").hexdigest()

_LONGS = T.ArrayType(T.LongType())
_ROW = T.StructType().add("shard", "long").add("root", "string").add("path", "string").add("above", "string")
for _name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "last"):
    _ROW = _ROW.add(_name, "long")
_ROW = _ROW.add("ends_sha256", "string")
# two rows of every shard hold its first and its last piece
_ROW = _ROW.add("edge", "integer").add("ids", _LONGS).add("sizes", _LONGS).add("ends", "boolean")
_COLUMNS = _ROW.names


def paths(root: str, ids: list[int], upto: int):
    """Hashes of the prefixes of 0 to ``upto`` ids below ``root``."""
    state = hashlib.sha256(root.encode())
    yield state.hexdigest()
    for i in ids[:upto]:
        state.update(b"%d," % i)
        yield state.hexdigest()


class Shard:
    """The ternary search trees of a range of sorted pieces."""

    def __init__(self):
        self.pieces: list[dict] = []
        self.ids = 0

    def add(self, piece: dict) -> None:
        self.pieces.append(piece)
        self.ids += len(piece["ids"]) + 1

    def grow(self) -> None:
        """Insert the pieces, medians first. ``low`` and ``high`` lead to siblings, ``down`` to the children."""
        self.key, self.low, self.high, self.down = [], [], [], []
        self.above, self.depth, self.size = [], [], []
        self.own: list[dict | None] = []  # the piece that ends at a node
        self.tops: dict[str, int] = {}
        self.named: dict[int, int] = {}  # smallest members of roots that are nodes of the layer above
        spans = [(0, len(self.pieces))]
        while spans:
            lo, hi = spans.pop()
            if lo < hi:
                middle = (lo + hi) // 2
                self._insert(self.pieces[middle])
                spans += (lo, middle), (middle + 1, hi)

    def _node(self, key: int, above: int, size: int) -> int:
        for column, value in ((self.key, key), (self.above, above), (self.size, size), (self.low, -1), (self.high, -1), (self.down, -1), (self.own, None)):
            column.append(value)
        self.depth.append(self.depth[above] + 1 if above >= 0 else 0)
        return len(self.key) - 1

    def _insert(self, piece: dict) -> None:
        root = piece["root"]
        if (at := self.tops.get(root)) is None:
            at = self.tops[root] = self._node(-1, -1, 0)
            if piece["top_conv_id"] is not None:
                self.named[at] = piece["top_conv_id"]
        for key, size in zip(piece["ids"], piece["sizes"]):
            link, here, nxt = self.down, at, self.down[at]
            while nxt >= 0 and self.key[nxt] != key:
                link, here = (self.low if key < self.key[nxt] else self.high), nxt
                nxt = link[here]
            if nxt < 0:
                nxt = link[here] = self._node(key, at, size)
            at = nxt
        self.own[at] = piece

    def walk(self, piece: dict) -> list[int]:
        """The nodes of a piece, from its root."""
        found = [self.tops[piece["root"]]]
        for key in piece["ids"]:
            at = self.down[found[-1]]
            while self.key[at] != key:
                at = self.low[at] if key < self.key[at] else self.high[at]
            found.append(at)
        return found

    def rows(self, number: int, base: int):
        """Rows of ``_ROW``; ``base`` is the depth of the roots. What a node has in this shard alone is final
        unless it is open, that is on the first or last path or a root."""
        self.grow()
        n = len(self.key)
        members, first, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
        for at in range(n - 1, -1, -1):
            piece = self.own[at]
            if piece is not None:
                members[at] += piece["n"]
                first[at] = piece["conv_id"] if first[at] is None else min(first[at], piece["conv_id"])
                children[at] += piece["more_children"] or 0
                leaves[at] += piece["more_leaves"] or 0
                saved[at] += piece["more_saved"] or 0
            if not children[at]:
                leaves[at] = 1
            saved[at] += (members[at] - 1) * self.size[at]
            up = self.above[at]
            first[at] = self.named.get(at, first[at])
            if up >= 0:
                members[up] += members[at]
                first[up] = first[at] if first[up] is None else min(first[up], first[at])
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        roots = {at: root for root, at in self.tops.items()}
        opened = {at: next(paths(root, [], 0)) for at, root in roots.items()}
        edges = self.pieces[0], self.pieces[-1]
        for piece in edges:
            opened.update(zip(self.walk(piece), paths(piece["root"], piece["ids"], len(piece["ids"]))))
        for at in range(n):
            up, piece = self.above[at], self.own[at]
            far = up in opened
            parent = None if far or up < 0 else first[up]
            ends = piece["ends_sha256"] if piece else None
            numbers = (first[at], base + self.depth[at], parent, members[at], children[at], leaves[at], saved[at], self.key[at] if up >= 0 else None)
            yield (number, roots.get(at), opened.get(at), opened[up] if far else None, *numbers, ends, None, None, None, None)
        for i, piece in enumerate(edges):
            yield (number, piece["root"], *[None] * 11, i, piece["ids"], piece["sizes"], piece["more_children"] is None)


def _shards(pieces: DataFrame, base: int) -> DataFrame:
    arrow = to_arrow_schema(_ROW)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def build(batches):
        number, own = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for piece in batch.to_pylist():
                own.add(piece)
                if own.ids >= SHARD_IDS:
                    yield table(list(own.rows(number, base)))
                    number, own = number + 1, Shard()
        if own.pieces:
            yield table(list(own.rows(number, base)))

    ordered = pieces.repartitionByRange("root", "ids").sortWithinPartitions("root", "ids")
    return materialise(ordered.mapInArrow(build, _ROW), "trie-shards")


_OFF = T.StructType().add("path", "string").add("n_children", "long").add("n_leaves", "long").add("saved_tokens", "long")


def _corrections(rows: DataFrame) -> DataFrame:
    """What neighbouring shards have both counted, by the path of the node: the nodes of their common
    prefix, and a piece that only seemed to end in a leaf."""
    edges = rows.filter("edge is not null").select("shard", "edge", "root", "ids", "sizes", "ends")
    follows = edges.filter("edge = 0").select("shard").withColumn("next", F.lead("shard").over(Window.orderBy("shard")))
    left = edges.filter("edge = 1").join(follows.dropna(), "shard").select("next", "root", "ids", "sizes", "ends")
    right = edges.filter("edge = 0").select(F.col("shard").alias("next"), F.col("root").alias("root_b"), F.col("ids").alias("ids_b"))
    arrow = to_arrow_schema(_OFF)

    def take_off(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["root"] != r["root_b"]:
                    continue
                a, b = r["ids"], r["ids_b"]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                twice = sum(r["sizes"][:same])
                for d, path in enumerate(paths(r["root"], a, same)):
                    twice -= r["sizes"][d - 2] if d > 1 else 0
                    out.append((path, -int(d < same), -int(len(a) == same and r["ends"]), twice))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 4, arrow)], schema=arrow)

    return left.join(right, "next").drop("next").mapInArrow(take_off, _OFF)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "last", "ends_sha256")


def _layer(pieces: DataFrame, layer: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of one layer (its roots only on layer 0), and the totals of its tries by root."""
    rows = _shards(pieces, layer * LAYER)
    nodes = rows.filter("edge is null")
    sums = ("n_children", "n_leaves", "saved_tokens")
    nothing = {c: F.lit(None).cast(_ROW[c].dataType) for c in ("root", "above", "conv_id", "depth", "last", "ends_sha256")}
    off = _corrections(rows).withColumns({**nothing, "n_convs": F.lit(0).cast("long")})
    columns = ["path", *nothing, "n_convs", *sums]
    found = nodes.filter("path is not null").select(*columns).unionByName(off.select(*columns))
    same = [F.max(c).alias(c) for c in ("root", "above", "depth", "last", "ends_sha256")]
    merged = found.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *same, *[F.sum(c).alias(c) for c in ("n_convs", *sums)])
    merged = materialise(merged, "trie-edges")
    named = merged.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.filter("path is null")
    far = inner.filter("above is not null").drop("parent_conv_id").select("above", *[c for c in NODE if c != "parent_conv_id"])
    opened = merged.filter("above is not null").select("above", *[c for c in NODE if c != "parent_conv_id"])
    out = inner.filter("above is null").select(*NODE).unionByName(far.unionByName(opened).join(named, "above").select(*NODE))
    tops = merged.filter("above is null")
    if layer == 0:
        out = out.unionByName(tops.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*NODE))
    return out, tops.select(F.col("root").alias("piece"), *[F.col(c).alias(c.replace("n_", "more_").replace("saved_tokens", "more_saved")) for c in sums])


def members_sha256(members: DataFrame) -> DataFrame:
    """``piece`` and ``ends_sha256``: SHA-256 of the piece's members in ascending order, joined by commas. A hash runs
    over one string; what is sorted over many tasks comes to it as blobs of many members each."""
    shape = T.StructType().add("piece", "string").add("at", "long").add("blob", "string")
    arrow = to_arrow_schema(shape)

    def blobs(batches):
        at, piece, own, size = TaskContext.get().partitionId() << 40, None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (piece, at, ",".join(own))], schema=arrow)

        for batch in batches:
            for new, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and (new != piece or size >= BLOB):
                    yield made()
                    at, own, size = at + 1, [], 0
                piece = new
                own.append(str(member))
                size += len(own[-1]) + 1
        if own:
            yield made()

    def hashes(batches):
        piece, state = None, None
        for batch in batches:
            out = []
            for new, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if new != piece:
                    if state is not None:
                        out.append((piece, state.hexdigest()))
                    piece, state = new, hashlib.sha256(blob.encode())
                else:
                    state.update(b"," + blob.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["piece", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (piece, state.hexdigest())], ["piece", "ends_sha256"])

    ordered = members.select("piece", "conv_id").repartitionByRange("piece", "conv_id").sortWithinPartitions("piece", "conv_id")
    cut = materialise(ordered.mapInArrow(blobs, shape), "member-blobs")
    return cut.repartition("piece").sortWithinPartitions("piece", "at").select("piece", "blob").mapInArrow(hashes, "piece string, ends_sha256 string")


def turn_digest(role, text):
    """Name of a turn: SHA-256 of role and text, apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def encoded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, pos, digest, size) with ids for digests, and the dictionary (digest, id, size)."""
    known = turns.groupBy("digest").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id())
    known = materialise(known, "dictionary")
    return turns.select("conv_id", "pos", "digest").join(known, "digest").select("conv_id", "pos", "id", "size"), known


def _pieces(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``layer``, ``root``, ``piece`` (the hash that names its end), ``conv_id``, ``ids``, ``sizes``, ``ends``: one row per
    conversation and ``LAYER`` turns, one without ids for a conversation without turns."""
    listed = (
        turns.withColumn("layer", F.floor((F.col("pos") - 1) / LAYER).cast("int"))
        .groupBy("conv_id", "layer")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("l"))
        .select("conv_id", "layer", F.col("l.id").alias("ids"), F.col("l.size").alias("sizes"))
    )
    none = F.array().cast("array<long>")
    bare = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("layer"), none.alias("ids"), none.alias("sizes"))
    listed = listed.unionByName(bare).withColumn("own", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    listed = materialise(listed, "pieces")
    last = listed.groupBy("conv_id").agg(F.max("layer").alias("top"))
    long = last.filter("top > 0")
    short = listed.join(long, "conv_id", "left_anti").select("conv_id", "layer", F.lit("").alias("root"), "ids", "sizes", "own", F.lit(True).alias("ends"))

    def chain(table: pa.Table) -> pa.Table:
        rows, root, out = sorted(zip(table["layer"].to_pylist(), table["own"].to_pylist())), "", []
        for layer, own in rows:
            out.append(root)
            root = hashlib.sha256(f"{root}{own}".encode()).hexdigest()
        conv = table["conv_id"].slice(0, 1).to_pylist() * len(rows)
        return pa.table({"conv_id": pa.array(conv, pa.int64()), "layer": pa.array([x for x, _ in rows], pa.int32()), "root": pa.array(out, pa.string())})

    # a row per LAYER turns
    roots = listed.join(long, "conv_id").select("conv_id", "layer", "own").groupBy("conv_id").applyInArrow(chain, "conv_id long, layer int, root string")
    rest = listed.join(roots, ["conv_id", "layer"]).join(long, "conv_id")
    rest = rest.select("conv_id", "layer", "root", "ids", "sizes", "own", (F.col("layer") == F.col("top")).alias("ends"))
    return short.unionByName(rest).withColumn("piece", F.sha2(F.concat("root", "own"), 256)).drop("own")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: ``turns`` has ``conv_id``, ``pos`` (from 1, without gaps), ``digest`` and ``size``
    of every turn, ``ids`` every ``conv_id`` once. See ``NODE``; ``last`` is the dictionary id of the node's last turn.

    A conversation without turns is a member of the root only. Without conversations there is no node. Any
    number of conversations may be equal, and any conversation may be long."""
    coded, _ = encoded(turns)
    every = materialise(_pieces(coded, ids), "trie-pieces")
    ends = members_sha256(every.filter("ends").select("piece", "conv_id"))
    once = every.groupBy("layer", "piece").agg(
        F.first("root").alias("root"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n")
    )
    once = materialise(once.join(ends, "piece", "left"), "trie-distinct")
    top = once.agg(F.max("layer")).first()[0]
    names = ("more_children", "more_leaves", "more_saved")
    out, totals = None, None
    for layer in range(top if top is not None else 0, -1, -1):
        own = once.filter(F.col("layer") == layer)
        if totals is None:
            own = own.withColumns({c: F.lit(None).cast("long") for c in names})
        else:
            own = own.join(totals, "piece", "left")
        if layer == 0:
            own = own.withColumn("top_conv_id", F.lit(None).cast("long"))
        else:
            above = once.filter(F.col("layer") == layer - 1).select(F.col("piece").alias("root"), F.col("conv_id").alias("top_conv_id"))
            own = own.join(above, "root")
        nodes, totals = _layer(own.select("root", "ids", "sizes", "conv_id", "top_conv_id", "n", "ends_sha256", *names), layer)
        out = nodes if out is None else out.unionByName(nodes)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``digest``, ``size`` of every turn: positions by turn (null first), then role and text. Null role
    and text are empty. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role, text)
    rows = rows.select("conv_id", "turn", "role", "text", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("size"))
    placed = rank_rows(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "pos")
    return materialise(placed.select("conv_id", "pos", "digest", "size"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations begin with the first h turns of the conversation at the foot of their hundred, and go on with
    their own after the first h; h is a hash of the id, 0 to 5. Also every ``conv_id``."""
    foot, h = F.col("conv_id") - F.col("conv_id") % 100, (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h")
    ids = materialise(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", foot.alias("foot"), h), "conversations")
    feet = ids.select(F.col("conv_id").alias("foot"), F.col("n").alias("n_foot"))
    ids = ids.join(feet, "foot", "left").withColumn("taken", F.least("h", F.coalesce("n_foot", F.lit(0))))
    heads = turns.filter("pos <= 5").withColumnRenamed("conv_id", "foot")
    lent = ids.select("conv_id", "foot", "h").join(heads, "foot").filter("pos <= h").select("conv_id", "pos", "digest", "size")
    own = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")
    return materialise(lent.unionByName(own), "rebuilt"), ids.select("conv_id")


def query(spark, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(turns, ids).drop("last")


SQL = """
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, max(p) AS n, c - c % 100 AS b, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)) AS bytes
    FROM t GROUP BY c
), k AS (
    SELECT c, n, b, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
    FROM ids
), r AS (
    SELECT k.c, t.p AS d, role, text FROM k JOIN t ON t.c = k.b AND t.p <= k.h
    UNION ALL
    SELECT k.c, t.p - k.h + least(k.h, coalesce(f.n, 0)), role, text
    FROM k JOIN t ON t.c = k.c AND t.p > k.h LEFT JOIN k AS f ON f.c = k.b
), named AS (
    SELECT c, d, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS whole FROM r
), path AS (
    SELECT c, d, size, md5(whole) AS path FROM named UNION ALL SELECT c, 0, 0, '' FROM k
), nodes AS (
    SELECT path, d, max(size) AS size, min(c) AS c, count(*) AS n FROM path GROUP BY path, d
), linked AS (
    SELECT nodes.*, path.path AS above FROM nodes LEFT JOIN path ON path.c = nodes.c AND path.d = nodes.d - 1
), children AS (
    SELECT above AS path, count(*) AS n FROM linked WHERE above IS NOT NULL GROUP BY above
), below AS (
    SELECT path.path, sum((x.n - 1) * x.size) AS saved, count(*) FILTER (WHERE children.n IS NULL) AS leaves
    FROM nodes x JOIN path ON path.c = x.c AND path.d <= x.d LEFT JOIN children ON children.path = x.path GROUP BY path.path
), ends AS (
    SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS members
    FROM (SELECT c, arg_max(path, d) AS path FROM path GROUP BY c) GROUP BY path
)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs,
       CAST(coalesce(children.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM linked x LEFT JOIN nodes up ON up.path = x.above LEFT JOIN children ON children.path = x.path
JOIN below ON below.path = x.path LEFT JOIN ends ON ends.path = x.path
"""
