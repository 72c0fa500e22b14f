"""Byte-level BPE over a global shuffle of distinct words.

1. A task splits its texts into pre-tokens and writes, per chunk of texts, every distinct
   word once and the texts as positions in that word list (a variable-length number for
   each pre-token, frequent words first). This is the exploded table of (word, position)
   with equal words of a chunk folded together.
2. The word lists are exploded into slices by a hash of the word and shuffled: equal words
   of all chunks meet, each distinct word is encoded once, and its ids go back to every
   chunk that sent it. A word that stands in every line is one entry per chunk.
3. Chunk and ids meet by chunk number (the chunk table is bucketed by it and stays where
   it is), and the ids are laid out by position.

Decoding gathers token bytes from the table of the vocabulary, whose size is that of the
vocabulary file, whatever the corpus.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.llm.tables import bucketed
from sparkcurate.session import materialise

CHUNK_BYTES = 4 << 20
LONG_TEXT = 1 << 20  # characters of a text, and of a piece of a longer one
PART_BYTES = 64 << 20  # of text, for each slice of the words
PACK = 1 << 18  # numbers packed at a time
LONG_WORD = 48
NEVER = b"\xff"  # no byte of UTF-8: parts words


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


# ---------------------------------------------------------------------------- splitting


@functools.lru_cache
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


# ---------------------------------------------------------------------------- encoding


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank is merged, the leftmost
    first, until no pair is in the vocabulary."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > LONG_WORD:
        return _encode_long(parts, ranks)
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(parts: list[bytes | None], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = [(ranks[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (made := parts[left] + parts[right]) in ranks:
                heapq.heappush(heap, (ranks[made], left, made))
    return [ranks[p] for p in parts if p is not None]


# ------------------------------------------------------------------------ packed numbers


def pack(numbers: np.ndarray) -> bytes:
    """Variable-length form: seven bits a byte, low ones first; below 2**35."""
    return b"".join(_pack(numbers[i : i + PACK]) for i in range(0, len(numbers), PACK))


def _pack(numbers: np.ndarray) -> bytes:
    x = numbers.astype(np.uint64)
    most = max(1, -(-int(x.max()).bit_length() // 7))
    size = np.ones(len(x), np.int64)
    for k in range(1, most):
        size += x >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(most):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((x[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = first + k <= last
        out[has] |= (data[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def lay_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


# ------------------------------------------------------------------------------ the jobs


def pieces(pattern: regex.Pattern, text: str):
    """The pre-tokens of ``text``, in lists of about ``LONG_TEXT`` characters."""
    if len(text) < LONG_TEXT:
        yield pattern.findall(text)
        return
    own, at = [], 0
    for found in pattern.finditer(text):
        own.append(found[0])
        if found.end() - at >= LONG_TEXT:
            yield own
            own, at = [], found.end()
    yield own


class _Chunk:
    """Texts of one chunk, or pieces of texts, as positions in a word list."""

    def __init__(self, parts: int):
        self.parts = parts
        self.words: dict[str, int] = defaultdict(itertools.count().__next__)
        self.keys: list = []
        self.cuts: list[tuple] = []  # number of a text in several pieces, and of the piece
        self.texts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key, cut: tuple, found: list[str], size: int) -> None:
        self.keys.append(key)
        self.cuts.append(cut)
        self.texts.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.bytes += size + 64

    def row(self, number: int) -> dict:
        sizes = [len(t) for t in self.texts]
        uses = np.zeros(len(self.words), np.int64)
        for at in range(0, len(self.texts), 256):
            uses += np.bincount(np.concatenate(self.texts[at : at + 256]), minlength=len(uses))
        by_use = np.argsort(-uses, kind="stable")
        new = np.empty(len(by_use), np.int32)
        new[by_use] = np.arange(len(by_use), dtype=np.int32)
        raw = [w.encode("utf-8") for w in self.words]
        self.words.clear()
        raw = [raw[i] for i in by_use]
        part = np.array([zlib.crc32(w) % self.parts for w in raw], np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        slices = [
            {"part": int(part[own[0]]), "words": NEVER.join([raw[i] for i in own])} for own in np.split(order, cuts[1:]) if len(own)
        ]
        del raw
        places = b"".join(pack(new[t]) for t in self.texts)
        self.texts.clear()
        cut, piece = zip(*self.cuts)
        return {"chunk": number, "keys": self.keys, "cut": cut, "piece": piece, "sizes": sizes, "places": places, "part": pack(part), "slices": slices}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs[key]`` and ``ids`` (the token ids of ``text``), one row per row of ``docs``.

    Null and empty texts have no ids. Keys may be null or repeat: rows travel as rows and
    are never joined on the key. Texts of any length are whole: long ones travel in pieces, cut
    between pre-tokens, and meet at the end. Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.col(f"`{text}`").cast("string")
    total, longest = (x or 0 for x in docs.agg(F.sum(F.octet_length(size)), F.max(F.length(size))).first())
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(buckets, math.ceil(total / PART_BYTES))
    slices = T.ArrayType(T.StructType().add("part", "integer").add("words", "binary"))
    shape = T.StructType().add("chunk", "long").add("keys", T.ArrayType(kind)).add("cut", T.ArrayType(T.LongType()))
    shape = shape.add("piece", T.ArrayType(T.IntegerType())).add("sizes", T.ArrayType(T.IntegerType()))
    shape = shape.add("places", "binary").add("part", "binary").add("slices", slices)
    arrow = to_arrow_schema(shape)

    def split(batches):
        words, first = compiled(pattern), TaskContext.get().partitionId() << 32
        numbers, texts = itertools.count(first), itertools.count(first)
        own = _Chunk(parts)
        for batch in batches:
            for row_key, row_text in zip(batch.column(0), batch.column(1)):
                row_key, row_text = row_key.as_py(), row_text.as_py() or ""
                number = next(texts) if len(row_text) >= LONG_TEXT else None
                for piece, found in enumerate(pieces(words, row_text)):
                    own.add(row_key, (number, piece), found, min(len(row_text), LONG_TEXT))
                    if own.bytes >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist([own.row(next(numbers))], arrow)
                        own = _Chunk(parts)
        if own.keys:
            yield pa.RecordBatch.from_pylist([own.row(next(numbers))], arrow)

    chunks = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(split, shape)
    chunks = bucketed(chunks, "chunk", buckets, "chunks")
    shared = spark.sparkContext.broadcast(ranks)

    def once(table: pa.Table) -> pa.Table:
        known, table_ranks = {}, shared.value
        ids, sizes = [], []
        for blob in table["words"]:
            flat, counts = [], []
            for word in blob.as_py().split(NEVER):
                if (found := known.get(word)) is None:
                    found = known[word] = encode_word(word, table_ranks)
                flat += found
                counts.append(len(found))
            ids.append(pack(np.array(flat, np.int64)))
            sizes.append(pack(np.array(counts, np.int64)))
        return pa.table([table["chunk"], table["part"], pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], ["chunk", "part", "ids", "sizes"])

    words = chunks.select("chunk", F.explode("slices").alias("s")).select("chunk", "s.part", "s.words")
    coded = words.groupBy("part").applyInArrow(once, "chunk long, part int, ids binary, sizes binary")
    result = T.StructType().add("key", kind).add("cut", "long").add("piece", "integer").add("ids", T.ArrayType(T.IntegerType()))
    out_arrow = to_arrow_schema(result)

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_arrow.empty_table()
        row = left.to_pylist()[0]
        part = unpack(row["part"])
        order = np.argsort(part, kind="stable")
        rows = sorted(range(right.num_rows), key=right["part"].to_pylist().__getitem__)
        empty = np.zeros(0, np.int64)
        flat = np.concatenate([empty, *[unpack(right["ids"][i].as_py()) for i in rows]])
        counts = np.concatenate([empty, *[unpack(right["sizes"][i].as_py()) for i in rows]])
        begin, size = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        begin[order], size[order] = np.cumsum(counts) - counts, counts
        places, flat = unpack(row["places"]), flat.astype(np.int32)
        lists, at = [], 0
        for n in row["sizes"]:
            own = places[at : at + n]
            lists.append(flat[lay_out(begin[own], size[own])])
            at += n
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else flat))
        plain = [pa.array(x, f.type) for x, f in zip((row["keys"], row["cut"], row["piece"]), out_arrow)]
        return pa.table([*plain, ids.cast(out_arrow.field("ids").type)], schema=out_arrow)

    rows = chunks.drop("slices").groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(lay, result)
    return _joined(rows, longest >= LONG_TEXT).withColumnRenamed("key", key)


def _joined(rows: DataFrame, cut: bool) -> DataFrame:
    """One row per text; pieces of a long one are put together."""
    if not cut:
        return rows.select("key", "ids")
    rows = materialise(rows, "ids")
    of = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    long = rows.filter("cut is not null").groupBy("cut").agg(F.first("key").alias("key"), F.flatten(of["ids"]).alias("ids"))
    return rows.filter("cut is null").select("key", "ids").unionByName(long.select("key", "ids"))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add the decoded bytes of ``ids``; null lists count as empty, an id outside the
    vocabulary is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    table: list = []

    @F.arrow_udf("binary")
    def gather(lists: pa.Array) -> pa.Array:
        if not table:
            words = [b""] * (max(shared.value.values()) + 1)
            for token, rank in shared.value.items():
                words[rank] = token
            sizes = np.array([len(w) for w in words])
            table.extend([np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes])
        data, starts, sizes = table
        found = []
        for one in lists:
            own = one.values.to_numpy(zero_copy_only=False) if one.is_valid else np.zeros(0, np.int64)
            if len(own) and (own.min() < 0 or own.max() >= len(sizes) or not sizes[own].all()):
                raise ValueError("an id is not in the vocabulary")
            found.append(data[lay_out(starts[own], sizes[own])].tobytes())
        return pa.array(found, pa.binary())

    return tokens.withColumn(out, gather(F.col(ids)))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode ``docs``: key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = decode(encode(docs, ranks, pattern or public_tokenizers.PATTERN, key, text), ranks)
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
