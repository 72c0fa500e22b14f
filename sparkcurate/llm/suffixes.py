"""Removal of long byte strings that occur more than once, by names of doubled length.

This is prefix doubling without its sorts. The rank of a position names the string that starts
there. Ranks of 8 bytes are the bytes themselves; ranks of 16, 32, ... bytes name the pair (rank
here, rank one length further), so a doubling costs one vector step and no shuffle. Ranks are
64-bit names instead of places in a sorted list: only equality counts here, and a name is the
same in every task. Two different strings share a name with probability 2**-64. That only lets a
start through the first comparison; the second, which decides, compares two independent names (96
bits).

Spark groups ranks twice, by slices of their range, and drops what is unique:

1. ranks of ``base`` bytes, the largest power of two up to the threshold, at sampled
   positions: those that hold the smallest rank of a window of ``length - base + 1``
   positions. Equal strings of ``length`` bytes have equal samples, so a start whose sample
   is unique is out, and about one position in 70 is sent;
2. for the surviving starts the pair (rank, rank ``length - base`` further), named twice,
   which names all ``length`` bytes: past the threshold, done.

A task sends each of its ranks once, in slices of the rank's range, and gets one bit per
rank back. A string that a third of all documents share is therefore sent once per bucket
of texts, not once per document. Exact copies are one row before anything else. Texts are
shuffled once and stay in a table bucketed by ``bucket``; every pass reads it in place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.tables import bucketed
from sparkcurate.session import materialise

LENGTH = 400
SLICE = 1 << 19
BUCKET_BYTES = 4 << 20
PART_BYTES = 16 << 20  # of text, for each slice of a rank's range
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
NAMINGS = ((M1, M2), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)))
S32, S29 = np.uint64(32), np.uint64(29)


def pair_rank(a: np.ndarray, b: np.ndarray, naming: int = 0) -> np.ndarray:
    """Name of the pairs (a, b), in one of two independent ways."""
    m, n = NAMINGS[naming]
    z = a * m
    z += b * n
    z ^= z >> S32
    z *= M3
    z ^= z >> S29
    return z


def ranks(data: np.ndarray, base: int, naming: int = 0) -> np.ndarray:
    """Names of the ``base``-byte strings at every position; ``base`` is a power of two from 8.
    Bytes are inverted first: 0 would be the name of NUL bytes, and stands for no start."""
    if len(data) < base:
        return np.zeros(0, np.uint64)
    at = np.invert(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)))
    done = 8
    while done < base:
        at = pair_rank(at[:-done], at[done:], naming)
        done *= 2
    return at


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every window of ``width``."""
    k, n = 1, len(x) - width + 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[:n], x[width - k : width - k + n]) if k < width else x


class Bucket:
    """The texts of one bucket, laid end to end."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        parts = [memoryview(t.as_buffer()) for t in texts.cast(pa.large_binary())]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts = self.ends - [len(p) for p in parts]
        self.length = length
        self.base = 1 << (length.bit_length() - 1)
        self.width = length - self.base + 1

    def slices(self):
        """``(first, rank, least, lead)``: from position ``first``, the ranks and the smallest
        rank of each start's window (0 where no start is); ``lead`` positions are the tail of
        the slice before."""
        total, w = len(self.data), self.width
        for at in range(0, total, SLICE):
            first = max(0, at - w + 1)
            rank = ranks(self.data[first : min(total, at + SLICE + self.length - 1)], self.base)
            if len(rank) < w:
                continue
            least = sliding(rank, w, np.minimum)
            valid = np.zeros(len(least), bool)
            lo = np.searchsorted(self.ends, first, "right")
            for s, e in zip(self.starts[lo:].tolist(), self.ends[lo:].tolist()):
                if s >= first + len(least):
                    break
                valid[max(0, s - first) : max(0, e - self.length + 1 - first)] = True
            least *= valid
            yield first, rank, least, at - first, min(len(least), at - first + SLICE)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct sampled ranks, and which of them stand at two positions here."""
        found = []
        for _, rank, least, lead, _ in self.slices():
            w = self.width
            padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
            chosen = sliding(padded, w, np.maximum)[: len(rank)] == rank
            chosen[:lead] = False
            chosen[lead + SLICE :] = False
            found.append(spread(rank[chosen]))
        return counted(found)

    def survivors(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose sample is in the sorted ``alive``, and both names of all their bytes."""
        places, names = [], []
        for first, rank, least, lead, stop in self.slices():
            own = least[lead:stop]
            if not len(own):
                continue
            turns = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            keep = held(spread(own[turns]), alive) & (own[turns] != 0)
            here = np.flatnonzero(np.repeat(keep, np.diff(np.append(turns, len(own))))) + lead
            if not len(here):
                continue
            places.append(here + first)
            lo, hi = here[0] + first, here[-1] + first + self.length
            both = (rank, here), (ranks(self.data[lo:hi], self.base, 1), here - here[0])
            far = self.width - 1
            named = np.stack([pair_rank(r[at], r[at + far], i) if far else r[at] for i, (r, at) in enumerate(both)], axis=1)
            named[:, 1] >>= S32
            names.append(named)
        return joined(places, np.int64), joined(names, np.uint64, 2)


def joined(parts: list[np.ndarray], kind, columns: int = 0) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros((0, columns) if columns else 0, kind)


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, counts = np.unique(joined(parts, np.uint64), return_counts=True)
    return names, counts > 1


def grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, which of them stand more than once, and the place of every row
    among them."""
    order = np.lexsort(names.T[::-1])
    rows = names[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]
    first = np.flatnonzero(new)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[first], np.diff(np.append(first, len(rows))) > 1, place


def held(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def spread(samples: np.ndarray) -> np.ndarray:
    """Samples are minima and crowd the low end of the range; an odd factor deals them out
    and keeps different ones different."""
    return samples * M1


def part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Slice of the rank's range; grows with the rank."""
    return ((names >> S32) * np.uint64(parts)) >> S32


def packed(names: np.ndarray) -> bytes:
    """Names for the shuffle: 8 bytes, or 12 of a pair whose second is below 2**32."""
    return names.tobytes() if names.ndim == 1 else names.view("<u4")[:, :3].tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` names."""
    if width == 1:
        return np.frombuffer(blob, np.uint64).reshape(-1, 1)
    words = np.zeros((len(blob) // 12, 4), "<u4")
    words[:, :3] = np.frombuffer(blob, "<u4").reshape(-1, 3)
    return words.view(np.uint64)


def first_name(names: np.ndarray) -> np.ndarray:
    return names[:, 0] if names.ndim == 2 else names


def sent(bucket: int, names: np.ndarray, parts: int) -> pa.Table:
    """One row per slice of the range that has ranks."""
    of = part_of(first_name(names), parts)
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
    blobs = [packed(x) for x in np.split(names, cuts[1:])] if len(cuts) else []
    return pa.table({"part": pa.array(of[cuts].astype(np.int32)), "bucket": pa.array([bucket] * len(cuts), pa.int32()), "names": pa.array(blobs, pa.binary())})


def answered(table: pa.Table, width: int) -> pa.Table:
    """For the rows of one slice: a bit per rank of ``width`` names, set if another bucket has
    it too."""
    blobs = [unpacked(x.as_py(), width) for x in table["names"]]
    _, again, place = grouped(np.concatenate(blobs))
    twice = again[place]
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(b) for b in blobs])[:-1])]
    return pa.table({"bucket": table["bucket"].cast(pa.int32()), "part": table["part"].cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


def shared(names: np.ndarray, answers: pa.Table, turn: int, parts: int) -> np.ndarray:
    """The answers of one round as a mask over the sorted ``names``."""
    got = {p: b for t, p, b in zip(answers["turn"].to_pylist(), answers["part"].to_pylist(), answers["bits"].to_pylist()) if t == turn}
    of, n = np.unique(part_of(first_name(names), parts), return_counts=True)
    masks = [np.unpackbits(np.frombuffer(got[int(p)], np.uint8), count=int(k)).astype(bool) for p, k in zip(of, n)]
    return joined(masks, bool)


SENT = "part int, bucket int, names binary"
ANSWER = "bucket int, part int, bits binary"
FOUND = "tid string, n_removed long, spans array<struct<start:long,end:long>>, kept binary, clean string"


def _texts(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, int]:
    """One row per distinct text of at least ``length`` bytes, in buckets: ``bucket, tid, copies, text``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    long = docs.select(body.alias("text")).filter(F.octet_length("text") >= length)
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(n, math.ceil(total / PART_BYTES))
    buckets = n * max(1, math.ceil(total / (n * BUCKET_BYTES)))
    once = long.withColumn("tid", F.sha2("text", 256)).groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    once = once.withColumn("bucket", F.pmod(F.hash("tid"), F.lit(buckets)))
    return bucketed(once, "bucket", n, "texts"), parts


def _round(texts: DataFrame, parts: int, length: int, answers: DataFrame | None) -> DataFrame:
    """Send the ranks of one round and write the answers."""

    def first(table: pa.Table) -> pa.Table:
        return sent(table["bucket"][0].as_py(), Bucket(table["text"], length).samples()[0], parts)

    def second(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent(0, np.zeros((0, 2), np.uint64), parts)
        names, _, _, _ = _second(Bucket(table["text"], length), got, parts)
        return sent(table["bucket"][0].as_py(), names, parts)

    groups = texts.select("bucket", "text").groupBy("bucket")
    ranked = groups.applyInArrow(first, SENT) if answers is None else groups.cogroup(answers.groupBy("bucket")).applyInArrow(second, SENT)
    turn = 1 if answers is None else 2  # as many names as a rank of the round has

    def answer(table: pa.Table) -> pa.Table:
        return answered(table, turn)

    return materialise(ranked.groupBy("part").applyInArrow(answer, ANSWER).withColumn("turn", F.lit(turn)), "ranks")


def _second(bucket: Bucket, answers: pa.Table, parts: int):
    names, twice = bucket.samples()
    places, ranked = bucket.survivors(names[shared(names, answers, 1, parts) | twice])
    own, again, place = grouped(ranked)
    return own, again, places, place


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per distinct text with something to remove: ``tid`` (its SHA-256 in hexadecimal),
    ``n_removed``, ``spans`` (maximal removed byte ranges, end excluded), ``kept`` (the
    remaining bytes) and ``clean`` (these as text, without pieces of characters that a cut
    has split). ``length`` is 16 or more."""
    texts, parts = _texts(docs, text, length)
    one = _round(texts, parts, length, None)
    both = one.union(_round(texts, parts, length, one))

    def spans(table: pa.Table, got: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            bucket = Bucket(table["text"], length)
            names, twice, places, place = _second(bucket, got, parts)
            starts = places[(shared(names, got, 2, parts) | twice)[place]]
            cuts = np.searchsorted(starts, np.stack([bucket.starts, bucket.ends]))
            for i, (tid, copies) in enumerate(zip(table["tid"].to_pylist(), table["copies"].to_pylist())):
                lo, hi = int(bucket.starts[i]), int(bucket.ends[i])
                own = starts[cuts[0, i] : cuts[1, i]] - lo
                if copies > 1:
                    rows.append((tid, hi - lo, [(0, hi - lo)], b""))
                elif len(own):
                    turns = np.flatnonzero(own[1:] > own[:-1] + length)
                    begin, end = own[np.append(0, turns + 1)], own[np.append(turns, len(own) - 1)] + length
                    body, edges = bucket.data[lo:hi].tobytes(), [0, *np.stack([begin, end], 1).ravel().tolist(), hi - lo]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((tid, int((end - begin).sum()), list(zip(begin.tolist(), end.tolist())), kept))
        cols = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        made = [[{"start": a, "end": b} for a, b in x] for x in cols[2]]
        clean = pa.array([x.decode("utf-8", "ignore") for x in cols[3]], pa.string())
        return pa.table([pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), pa.array(made, kinds[2]), pa.array(cols[3], kinds[3]), clean], ["tid", "n_removed", "spans", "kept", "clean"])

    return texts.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(spans, FOUND)


def text_id(text: Column) -> Column:
    """SHA-256 of a text's bytes; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, size: str | None = None) -> DataFrame:
    """``docs`` with every repeated string cut out of ``text``; texts that lose all their
    bytes leave their row. A null text stays null. Where a cut splits a character, its
    remaining bytes go as well, so that the text stays valid. Repeated rows are copies:
    both lose their strings. ``size`` names a column of character counts to renew where a text
    has changed. Other columns keep their names and values."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_id(F.col(f"`{text}`")).alias("tid"))
    found = materialise(repeats(docs.select(F.col(f"`{text}`").alias("text")), "text", length).select("tid", "clean"), "kept")
    out = rows.join(found, "tid", "left")
    clean = F.coalesce("clean", f"row.`{text}`")
    new = {text: clean}
    if size in names:
        kind = docs.schema[size].dataType
        new[size] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(kind)).otherwise(F.col(f"row.`{size}`"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text_id(F.col("text")).alias("tid"))
    found = repeats(docs).select("tid", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(found, "tid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "tid").alias("kept_sha256"),
        (F.col("n_bytes") - F.coalesce("n_removed", zero)).alias("n_kept"),
        (F.coalesce("n_removed", zero) > 0).alias("removed"),
    )
