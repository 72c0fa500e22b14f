"""Benchmark decontamination by suffix arrays of the training texts.

Training texts stay where they are: a task lays those of its partition end to end, a few
megabytes at a time (a shard), and sorts the word suffixes of the shard by prefix doubling.
Every test suffix is then binary-searched in the shard, word by word, which gives its longest
verbatim match and, as one interval of the suffix array, all its places. Words that no test
item holds end a suffix, and a suffix whose first two words begin no window is left out of the
array: neither can match.

Test items are cut into pieces that overlap by one word less than a window, and pieces are
dealt into blocks of bounded size. One block at a time is broadcast, whatever the benchmark's size.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.session import materialise

WINDOW = 10
PIECE = 2000  # words of a test piece
BLOCK_WORDS = 200_000  # words of the pieces that are broadcast together
SHARD_BYTES = 4 << 20
SLICE_BYTES = 1 << 20  # of a long text, split into words at a time

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))

_SPAN = T.StructType().add("start", "long").add("end", "long")
_LONGEST = T.StructType().add("length", "long").add("start", "long").add("item", "string")
FOUND = T.StructType().add("n_words", "long").add("n_hit", "long").add("spans", T.ArrayType(_SPAN))
FOUND = FOUND.add("items", T.ArrayType(T.StringType())).add("longest", _LONGEST)
PIECES = T.StructType().add("item", "string").add("words", "binary").add("n", "integer").add("short", "boolean")


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    return text.translate(FOLD).split()


def slices(text: bytes):
    """``text`` folded, in slices that end between words."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``PIECE`` words per test item; each window stands whole in one. An item
    shorter than a window is one piece and one window. Items without words have no piece."""
    arrow = to_arrow_schema(PIECES)

    def cut(batches):
        for batch in batches:
            out = []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(_bytes(body))
                for at in range(0, max(1, len(words) - window + 1), PIECE - window + 1):
                    own = words[at : at + PIECE]
                    if own:
                        out.append({"item": i, "words": b" ".join(own), "n": len(own), "short": len(own) < window})
            yield pa.RecordBatch.from_pylist(out, arrow)

    named = F.coalesce(F.col(f"`{item}`").cast("string"), F.lit(""))
    return benchmark.select(named, F.col(f"`{text}`").cast("string")).mapInArrow(cut, PIECES).distinct()


@dataclass
class Block:
    """The suffixes of some test pieces that begin a window."""

    codes: dict[bytes, int]  # word to its number, from 1
    seq: np.ndarray  # the pieces' words end to end, 0 after each
    at: np.ndarray  # where the suffixes begin
    room: np.ndarray  # words up to the end of their piece
    need: np.ndarray  # words of their window
    item: np.ndarray  # number of their item
    items: list[str]

    @classmethod
    def of(cls, rows, window: int = WINDOW) -> Block:
        codes: dict[bytes, int] = {}
        items: dict[str, int] = {}
        seq, at, room, need, item, base = [], [], [], [], [], 0
        for r in sorted(rows, key=lambda r: (r["item"], bytes(r["words"]))):
            own = [codes.setdefault(w, len(codes) + 1) for w in bytes(r["words"]).split()]
            starts = np.arange(1 if r["short"] else len(own) - window + 1)
            seq.append(np.array([*own, 0], np.int64))
            at.append(starts + base)
            room.append(len(own) - starts)
            need.append(np.full(len(starts), len(own) if r["short"] else window))
            item.append(np.full(len(starts), items.setdefault(r["item"], len(items))))
            base += len(own) + 1
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seq, at, room, need, item)]
        return cls(codes, *flat, list(items))


def suffix_array(seq: np.ndarray, starts: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the words that follow, by prefix doubling up to ``depth`` words;
    0 in ``seq`` ends a suffix, ``room`` has the words before it."""
    rank, k = seq.copy(), 1
    real = np.flatnonzero(seq)
    while k < depth:
        far = np.minimum(real + k, len(seq) - 1)
        key = rank[real] * (rank.max() + 1) + np.where(room[real] > k, rank[far], 0)
        names, place = np.unique(key, return_inverse=True)
        rank[real] = place + 1
        if len(names) == len(real):
            break
        k *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(seq, order, lo, hi, depth, word, right: bool) -> np.ndarray:
    """Per query the first place in order[lo:hi] whose word at ``depth`` is not below (``right``:
    is above) ``word``."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        here = seq[order[mid] + depth]
        low = here <= word[live] if right else here < word[live]
        lo[live] = np.where(low, mid + 1, lo[live])
        hi[live] = np.where(low, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def search(seq: np.ndarray, order: np.ndarray, block: Block):
    """For every test suffix the interval of its window in the suffix array (empty if it does not
    occur), the length of its longest match and the interval of that."""
    n = len(block.at)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order))
    window, length = np.zeros((n, 2), np.int64), np.zeros(n, np.int64)
    live = np.arange(n) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while len(live):
        word = block.seq[block.at[live] + depth]
        left = _bound(seq, order, lo[live], hi[live], depth, word, False)
        right = _bound(seq, order, left, hi[live], depth, word, True)
        depth += 1
        ok = left < right
        live = live[ok]
        lo[live], hi[live], length[live] = left[ok], right[ok], depth
        full = live[block.need[live] == depth]
        window[full, 0], window[full, 1] = lo[full], hi[full]
        live = live[block.room[live] > depth]
    return window, length, np.stack([lo, hi], axis=1)


def _starts(seq: np.ndarray, room: np.ndarray, block: Block) -> np.ndarray:
    """Positions that may begin a window: by the first word, then by the first two."""
    size = len(block.codes) + 1
    one = np.zeros(size, bool)
    one[block.seq[block.at[block.need == 1]]] = True
    two = block.at[block.need > 1]
    first = np.zeros(size, bool)
    first[block.seq[two]] = True
    pairs = np.unique(block.seq[two] * size + block.seq[two + 1])
    least = block.need[block.need > 1].min() if len(two) else 2
    at = np.flatnonzero(first[seq] & (room >= least))
    pair = seq[at] * size + seq[np.minimum(at + 1, len(seq) - 1)]
    held = np.isin(pair, pairs)
    return np.union1d(at[held], np.flatnonzero(one[seq]))


class Shard:
    """The texts of one shard as numbers of test words, 0 for any other word and after each text."""

    def __init__(self, block: Block):
        self.block = block
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        n = 0
        for part in slices(text):
            words = part.split()
            n += len(words)
            self.parts.append(np.fromiter(map(self.block.codes.get, words, itertools.repeat(0)), np.int64, len(words)))
        self.parts.append(np.zeros(1, np.int64))
        self.sizes.append(n)
        self.bytes += len(text) + 64

    def found(self) -> list[dict]:
        """Per text: words, hit words, maximal runs of them, items, the longest match."""
        block, seq = self.block, np.concatenate(self.parts)
        ends = np.cumsum(np.array(self.sizes) + 1) - 1
        begins = ends - self.sizes
        stops = np.flatnonzero(seq == 0)
        room = stops[np.searchsorted(stops, np.arange(len(seq)))] - np.arange(len(seq))
        starts = _starts(seq, room, block)
        plain = [{"n_words": n, "n_hit": 0, "spans": [], "items": [], "longest": None} for n in self.sizes]
        if not len(starts):
            return plain
        depth = int(block.room.max())
        # the array is sorted over what follows the starts only
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + np.minimum(room[starts], depth), -1)
        near = np.cumsum(edge[:-1]) > 0
        near[starts + np.minimum(room[starts], depth)] = True  # a word that ends the suffix
        kept = np.flatnonzero(near)
        small, place = np.where(edge[:-1].cumsum()[kept] > 0, seq[kept], 0), np.searchsorted(kept, starts)
        order = suffix_array(small, place, room[kept], depth)
        window, length, best = search(small, order, block)
        at = kept[order]  # of the array's suffixes, in the shard
        doc = np.searchsorted(ends, at)

        marks, pairs, top = np.zeros(len(seq) + 1, np.int64), [], {}
        hit = np.flatnonzero(window[:, 0] < window[:, 1])
        spots, which = np.unique(np.stack([window[hit, 0], window[hit, 1], block.need[hit]], axis=1), axis=0, return_inverse=True)
        by = np.split(hit[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1]) if len(hit) else []
        for (lo, hi, need), own in zip(spots.tolist(), by):
            marks[at[lo:hi]] += 1
            np.add.at(marks, at[lo:hi] + need, -1)
            docs, items = np.unique(doc[lo:hi]), np.unique(block.item[own])
            pairs.append(np.unique(np.stack([np.repeat(docs, len(items)), np.tile(items, len(docs))], axis=1), axis=0))
            for d in docs.tolist():
                top[d] = max(top.get(d, (0, 0, 0)), (need, -int(at[lo:hi][doc[lo:hi] == d].min() - begins[d]), -int(items.min())))
        for j in hit[length[hit] > block.need[hit]].tolist():
            lo, hi = best[j]
            for p, d in zip(at[lo:hi].tolist(), doc[lo:hi].tolist()):
                top[d] = max(top[d], (int(length[j]), -int(p - begins[d]), -int(block.item[j])))
        cover = np.cumsum(marks[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
        owner = np.searchsorted(ends, turns[::2])
        for d, s, e in zip(owner.tolist(), turns[::2].tolist(), turns[1::2].tolist()):
            b = int(begins[d])
            plain[d]["spans"].append({"start": s - b, "end": e - b})
            plain[d]["n_hit"] += e - s
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
            plain[d]["items"].append(block.items[i])
        for d, (n, s, i) in top.items():
            plain[d]["longest"] = {"length": n, "start": -s, "item": block.items[-i]}
            plain[d]["items"].sort()
        return plain


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> list[DataFrame]:
    """The test pieces, in tables of about ``BLOCK_WORDS`` words."""
    cut = materialise(pieces(benchmark, item, text, window), "test-pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0
    n = math.ceil(total / BLOCK_WORDS)
    if n <= 1:
        return [cut] * n
    return [cut.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i) for i in range(n)]


def _scan(rows: DataFrame, block: Block) -> DataFrame:
    """``row``, ``found`` of rows of (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    shape = T.StructType([rows.schema["row"], T.StructField("found", FOUND)])
    arrow = to_arrow_schema(shape)

    def scan(batches):
        shard, own = Shard(shared.value), []

        def made():
            out = pa.array(shard.found(), arrow.field("found").type)
            row = pa.concat_arrays(own).cast(arrow.field("row").type)
            return pa.RecordBatch.from_arrays([row, out], schema=arrow)

        for batch in batches:
            row, text = batch.column(0), batch.column(1)
            first = 0
            for i in range(batch.num_rows):
                shard.add(_bytes(text[i]))
                if shard.bytes >= SHARD_BYTES:
                    own.append(row.slice(first, i + 1 - first))
                    yield made()
                    shard, own, first = Shard(shared.value), [], i + 1
            if first < batch.num_rows:
                own.append(row.slice(first))
        if shard.sizes:
            yield made()

    return rows.select("row", "text").mapInArrow(scan, shape)


def merged(parts: list[dict]) -> dict:
    """The findings of several blocks about one text as one."""
    spans: list[dict] = []
    for s in sorted((s for p in parts for s in p["spans"]), key=lambda s: s["start"]):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], s["end"])
        else:
            spans.append(dict(s))
    best = [p["longest"] for p in parts if p["longest"]]
    return {
        "n_words": parts[0]["n_words"],
        "n_hit": sum(s["end"] - s["start"] for s in spans),
        "spans": spans,
        "items": sorted({i for p in parts for i in p["items"]}),
        "longest": min(best, key=lambda x: (-x["length"], x["start"], x["item"])) if best else None,
    }


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row`` (the columns of ``docs``) and ``found``, one row per row of ``docs``: ``n_words``,
    ``n_hit`` (words inside an occurrence of a test window), ``spans`` (maximal runs of these, by word,
    end excluded), ``items`` (sorted ids of the test items with a window in the text) and ``longest``
    (the longest verbatim match: words, first word, item; ties go to the first place).

    Null and empty texts have no words; an item without words matches nothing; a null item id
    counts as the empty id. Rows repeat as they do in ``docs``; keys are not used. Texts of any
    length are whole. Items of over ``PIECE`` words have their longest match within a piece."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    tables = _blocks(benchmark, item, item_text, window)

    def block(table: DataFrame | None) -> Block:
        return Block.of([] if table is None else table.toPandas().to_dict("records"), window)

    if len(tables) <= 1:
        return _scan(rows, block(tables[0] if tables else None))
    numbered = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = None
    for table in tables:
        one = materialise(_scan(numbered.select(F.col("number").alias("row"), "text"), block(table)), "matches")
        found = one if found is None else found.unionAll(one.filter("found.n_hit > 0"))
    lists = found.groupBy("row").agg(F.collect_list("found").alias("parts")).withColumnRenamed("row", "number")
    kind = T.StructType([numbered.schema["row"], T.StructField("found", FOUND)])
    arrow = to_arrow_schema(kind)

    def join(batches):
        for batch in batches:
            out = pa.array([merged(x) for x in batch.column(1).to_pylist()], arrow.field("found").type)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field("row").type), out], schema=arrow)

    return numbered.select("number", "row").join(lists, "number").select("row", "parts").mapInArrow(join, kind)


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that hold no window of a test item, columns as they are."""
    return matches(docs, benchmark, **names).filter("found.n_hit = 0").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs.select("doc_id", "text"), bench).select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH folded AS (
    SELECT 0 AS bench, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL
    SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT bench, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded
), items AS (
    SELECT id, w, least(len(w), 10) AS n FROM words WHERE bench = 1 AND len(w) > 0
), windows AS (
    SELECT DISTINCT id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM items)
), grams AS (
    SELECT id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
    FROM (SELECT words.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS p
          FROM words CROSS JOIN (SELECT DISTINCT n FROM items) l WHERE bench = 0)
), found AS (
    SELECT grams.id AS doc_id, windows.id AS item_id, p, grams.n FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS place FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM found) GROUP BY doc_id
)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON hit.doc_id = words.id LEFT JOIN named ON named.doc_id = words.id
WHERE bench = 0
"""
