"""Alignment of two tokenizers over the same texts, each distinct text once.

1. Rows are shuffled by the hash of their full text; equal texts become one row with a count
   of copies. A task tokenises each text with both tokenizers and cuts the token bytes into groups
   where both end a token. Links (pairs of overlapping tokens) are numbers into the pair list of
   their chunk of texts; a pair of ids is one 32-bit code.
2. The pair lists go in slices by a hash of the pair to the task that adds up, over all chunks, how
   many documents hold the pair. Texts were counted by their copies, so a hot text is one
   entry, and a pair that stands in every text is one entry per chunk.
3. Counts return to their chunks, measures are summed per text, and join back to the rows by the
   hash of the text. The highest count of every id of the first tokenizer, a table no longer
   than its vocabulary, is broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.llm.bpe import pack, unpack
from sparkcurate.llm.tables import bucketed
from sparkcurate.session import materialise

CHUNK_BYTES = 4 << 20
PART_BYTES = 64 << 20  # of text, for each part of the pair counts
SEGMENT = 1 << 16  # characters of a long text that are tokenised together
MIX = np.uint64(0x9E3779B97F4A7C15)
# Between two letters a single space begins a token of both tokenizers: texts may be cut before it.
_CUT = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")


@dataclass
class Files:
    """Both vocabulary files, read on the driver; tasks get their bytes."""

    a: str
    b: bytes
    pattern: str | None  # of the pre-tokens, if byte ranks give the ids of ``a``
    segment: int

    @classmethod
    def read(cls, a_path: str, b_path: str, pattern: str | None) -> Files:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            own = cls(a.read(), b.read(), pattern, SEGMENT)
        return own if pattern and _by_rank(own.a) else cls(own.a, own.b, None, SEGMENT)

    def key(self) -> str:
        return hashlib.sha256(self.a.encode() + self.b + repr((self.pattern, self.segment)).encode()).hexdigest()


def byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies and the bytes they stand for: printable Latin-1 bytes are
    themselves, the others follow from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(other)}}


def _by_rank(text: str) -> bool:
    """Whether merging the adjacent bytes whose union has the lowest id gives the ids of this
    vocabulary. It does if ids follow the order of merges and every entry, encoded alone, is itself:
    parts that the merge list would not join then never stand next to each other."""
    from tokenizers import Tokenizer

    spec = json.loads(text)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "unk_token", "end_of_word_suffix"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    own = Tokenizer.from_str(text).model
    return all(x < y for x, y in zip(made, made[1:])) and all([t.id for t in own.tokenize(w)] == [i] for w, i in model["vocab"].items())


@dataclass
class Aligned:
    """Ids of both, which tokens end a group, and the links as positions in both."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    links: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
        at_a = np.zeros(int(a_ends[-1]) + 1, bool)
        at_b = at_a.copy()
        at_a[a_ends], at_b[b_ends] = True, True
        both = at_a & at_b
        # every stretch between neighbouring ends lies in one token of either: one link
        ends = np.flatnonzero(at_a | at_b)
        in_a, in_b = at_a[ends], at_b[ends]
        return cls(a, b, both[a_ends], both[b_ends], (np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b))

    def pairs(self) -> np.ndarray:
        """The id pairs of the links, as one number each."""
        return (self.a[self.links[0]] << 32 | self.b[self.links[1]]).view(np.uint64)


class Tokenizers:
    """Both tokenizers within a task, with the bytes of their tokens."""

    def __init__(self, files: Files):
        import sentencepiece
        from tokenizers import Tokenizer

        self.segment = files.segment
        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.fast = None
        if files.pattern:
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.a_bytes) if t}
            self.fast = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        # rendered ids, each with the mark that follows it: within its list, at the list's end
        self.shown = [f"{i}{m}" for i in range(len(self.a_bytes)) for m in ",|"] + [f"{i}{m}" for i in range(len(self.b_bytes)) for m in ",;"]

    def segments(self, text: str):
        """``text`` in pieces; the space between two pieces belongs to neither. At every border both
        tokenizers end a token, so pieces are aligned on their own."""
        at = 0
        while self.cuts and len(text) - at > self.segment:
            cut = _CUT.search(text, at + self.segment)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def align(self, part: str) -> Aligned | None:
        """Tokens of both for space + ``part``; None if either's bytes are not those of it."""
        if self.fast and len(part) <= 2 * self.segment:
            a = self.fast.encode_ordinary(" " + part)
        else:
            a = self.a.encode(" " + part, add_special_tokens=False).ids
        b, whole = self.b.encode(part), b" " + part.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        return Aligned.of(x, y, np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y]))

    def render(self, one: Aligned) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups, as ids of both."""
        n, m = len(one.a), len(one.b)
        out = np.empty(n + m, np.int64)
        group_a, group_b = (np.cumsum(x) - x for x in (one.a_last, one.b_last))
        before = np.concatenate(([0], np.flatnonzero(one.b_last) + 1))  # tokens of b in the groups before
        up_to = np.flatnonzero(one.a_last) + 1  # tokens of a up to the group's end
        out[np.arange(n) + before[group_a]] = 2 * one.a + one.a_last
        out[np.arange(m) + up_to[group_b]] = 2 * (len(self.a_bytes) + one.b) + one.b_last
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]


SIZES = ("n_a", "n_b", "n_groups", "n_links")
_SLICE = T.StructType().add("part", "integer").add("codes", "binary").add("counts", "binary")
_CHUNK = T.StructType().add("chunk", "long").add("tids", T.ArrayType(T.StringType())).add("shas", T.ArrayType(T.StringType()))
for _name in SIZES:
    _CHUNK = _CHUNK.add(_name, T.ArrayType(T.LongType()))
_CHUNK = _CHUNK.add("owners", T.ArrayType(T.IntegerType())).add("places", T.ArrayType(T.BinaryType()))
_CHUNK = _CHUNK.add("codes", "binary").add("slices", T.ArrayType(_SLICE))


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """Part of a pair, by a hash."""
    return ((((codes * MIX) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class _Chunk:
    """Texts of one chunk, with their links as numbers into one list of pairs."""

    def __init__(self, tools: Tokenizers, parts: int):
        self.tools, self.parts, self.bytes = tools, parts, 0
        self.tids: list[str] = []
        self.shas: list[str] = []
        self.copies: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.own: list[np.ndarray] = []  # distinct pairs of each text
        self.links: list[tuple[int, np.ndarray]] = []  # text, and links of a piece as numbers into these

    def add(self, tid: str, text: str, copies: int) -> None:
        self.bytes += len(text) + 200
        sha, sizes, pieces = hashlib.sha256(), np.zeros(4, np.int64), []
        for part in self.tools.segments(text):
            if (one := self.tools.align(part)) is None:
                return
            sha.update((";" if pieces else "").encode() + self.tools.render(one).encode())
            codes, place = np.unique(one.pairs(), return_inverse=True)
            pieces.append((codes, place.astype(np.uint32)))
            sizes += (len(one.a), len(one.b), int(one.a_last.sum()), len(place))
        own = pieces[0][0] if len(pieces) == 1 else np.unique(np.concatenate([c for c, _ in pieces]))
        for codes, place in pieces:
            self.links.append((len(self.tids), place if len(pieces) == 1 else np.searchsorted(own, codes).astype(np.uint32)[place]))
        self.own.append(own)
        self.tids.append(tid)
        self.shas.append(sha.hexdigest())
        self.copies.append(copies)
        self.sizes.append(sizes)

    def row(self, number: int) -> dict:
        lens = [len(x) for x in self.own]
        codes, place, uses = np.unique(np.concatenate(self.own), return_inverse=True, return_counts=True)
        counts = np.bincount(place, np.repeat(np.array(self.copies, np.float64), lens), len(codes)).astype(np.int64)
        order = np.argsort(-uses, kind="stable")  # pairs of many texts get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, at = rank[place], np.cumsum([0, *lens])
        packed = [pack(place[at[t] : at[t + 1]][x]) for t, x in self.links]
        codes, counts = codes[order], counts[order]
        part = part_of(codes, self.parts)
        by = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[by], append=-1)) + 1
        slices = [{"part": int(part[x[0]]), "codes": codes[x].tobytes(), "counts": pack(counts[x])} for x in np.split(by, ends[:-1])]
        sizes = dict(zip(SIZES, np.array(self.sizes).T.tolist()))
        owners = [t for t, _ in self.links]
        return {"chunk": number, "tids": self.tids, "shas": self.shas, "owners": owners, "places": packed, "codes": codes.tobytes(), "slices": slices, **sizes}


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text that is not null or empty: ``tid`` (its SHA-256), ``text``, ``copies``."""
    body = docs.select(F.col(f"`{text}`").cast("string").alias("text")).filter("text <> ''")
    return body.groupBy(F.sha2("text", 256).alias("tid")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))


_BUILT: dict[str, Tokenizers] = {}


def _tools(files: Files) -> Tokenizers:
    """The tokenizers of a task; a worker keeps the last ones it built."""
    key = files.key()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tokenizers(files)
    return _BUILT[key]


def chunks(docs: DataFrame, files: Files, text: str = "text") -> tuple[DataFrame, int]:
    """The aligned distinct texts, in chunks, as a table bucketed by ``chunk``; and the number of parts
    that the pairs are dealt into. Texts whose tokens do not give their bytes back are left out."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(buckets, math.ceil(total / PART_BYTES))
    shared, arrow = spark.sparkContext.broadcast(files), to_arrow_schema(_CHUNK)

    def cut(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        own = _Chunk(_tools(shared.value), parts)
        for batch in batches:
            for tid, body, copies in zip(*batch.columns):
                own.add(tid.as_py(), body.as_py(), copies.as_py())
                if own.bytes >= CHUNK_BYTES and own.tids:
                    yield pa.RecordBatch.from_pylist([own.row(next(numbers))], arrow)
                    own = _Chunk(own.tools, parts)
        if own.tids:
            yield pa.RecordBatch.from_pylist([own.row(next(numbers))], arrow)

    made = distinct_texts(docs, text).select("tid", "text", "copies").mapInArrow(cut, _CHUNK)
    return bucketed(made, "chunk", buckets, "alignment"), parts


_ANSWER = T.StructType().add("chunk", "long").add("part", "integer").add("totals", "binary")
_ANSWER = _ANSWER.add("codes", "binary").add("sums", "binary")


def pair_counts(made: DataFrame) -> DataFrame:
    """Per chunk and part the documents, corpus-wide, that hold each of the chunk's pairs (``totals``);
    the first row of a part also lists all its pairs (``codes``) and their counts (``sums``)."""

    def add(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x.as_py(), np.uint64) for x in table["codes"]]
        counts = [unpack(x.as_py()) for x in table["counts"]]
        known, place = np.unique(np.concatenate(codes), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts).astype(np.float64), len(known)).astype(np.int64)
        at = np.cumsum([0, *map(len, codes)])
        totals = [pack(sums[place[i:j]]) for i, j in zip(at, at[1:])]
        first = [known.tobytes(), *[None] * (len(totals) - 1)], [pack(sums), *[None] * (len(totals) - 1)]
        return pa.table([table["chunk"], table["part"], *[pa.array(x, pa.binary()) for x in (totals, *first)]], _ANSWER.names)

    rows = made.select("chunk", F.explode("slices").alias("s")).select("chunk", "s.part", "s.codes", "s.counts")
    return materialise(rows.groupBy("part").applyInArrow(add, _ANSWER), "pair-counts")


def pairs(answers: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``docs``: in how many documents a token a overlaps a token b."""

    def spell(batches):
        for batch in batches:
            for codes, sums in zip(*batch.columns):
                own = np.frombuffer(codes.as_py(), np.uint64)
                columns = [(own >> np.uint64(32)).astype(np.int32), (own & np.uint64(0xFFFFFFFF)).astype(np.int32), unpack(sums.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "docs"])

    return answers.filter("codes is not null").select("codes", "sums").mapInArrow(spell, "a int, b int, docs long")


MEASURES = T.StructType().add("tid", "string")
for _name in (*SIZES, "n_best", "count_sum"):
    MEASURES = MEASURES.add(_name, "long")
MEASURES = MEASURES.add("groups_sha256", "string")


def measures(docs: DataFrame, files: Files, text: str = "text") -> DataFrame:
    """One row per distinct text that both tokenizers give back: ``tid``, the numbers of tokens, groups and
    links, ``n_best`` (links whose pair is its first id's most frequent), ``count_sum`` (their pairs' counts
    added up) and ``groups_sha256``. Texts of any length are whole."""
    made, parts = chunks(docs, files, text)
    answers = pair_counts(made)
    best = pairs(answers).groupBy("a").agg(F.max("docs").alias("docs")).toPandas()  # a row per id of the vocabulary at most
    top = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    top[best["a"]] = best["docs"]
    shared = docs.sparkSession.sparkContext.broadcast(top)
    arrow = to_arrow_schema(MEASURES)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        codes = np.frombuffer(left["codes"][0].as_py(), np.uint64)
        total = np.empty(len(codes), np.int64)
        by = np.concatenate([unpack(right["totals"][i].as_py()) for i in np.argsort(right["part"].to_numpy())])
        total[np.argsort(part_of(codes, parts), kind="stable")] = by
        is_best = total == shared.value[(codes >> np.uint64(32)).astype(np.int64)]
        n = len(left["tids"][0])
        sums = np.zeros((2, n), np.int64)
        for t, blob in zip(left["owners"][0].as_py(), left["places"][0]):
            place = unpack(blob.as_py())
            sums[:, t] += int(is_best[place].sum()), int(total[place].sum())
        plain = [left[c][0].values for c in ("tids", *SIZES)]
        return pa.table([*plain, pa.array(sums[0]), pa.array(sums[1]), left["shas"][0].values], schema=arrow)

    columns = ("chunk", "tids", "shas", *SIZES, "owners", "places", "codes")
    return made.select(*columns).groupBy("chunk").cogroup(answers.select("chunk", "part", "totals").groupBy("chunk")).applyInArrow(judge, MEASURES)


def aligned(docs: DataFrame, files: Files, text: str = "text") -> DataFrame:
    """``tid``, ``text``, ``copies`` and ``groups`` (``a1,a2|b1;a3|b2,b3``) of every distinct text; null groups where
    a tokenizer does not give the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    @F.arrow_udf("string")
    def groups(texts: pa.Array) -> pa.Array:
        tools, out = _tools(shared.value), []
        for body in texts:
            found = [tools.align(x) for x in tools.segments(body.as_py())]
            out.append(None if any(x is None for x in found) else ";".join(map(tools.render, found)))
        return pa.array(out, pa.string())

    return distinct_texts(docs, text).withColumn("groups", groups("text"))


def with_measures(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``) and ``found`` (see ``MEASURES``), one row per row of ``docs``. Texts that are
    null or empty, or that a tokenizer changes, have zeros and the empty string. Equal texts have equal
    measures and count once each; keys are not used."""
    import public_tokenizers

    named = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    files = Files.read(*named, pattern or public_tokenizers.PATTERN)
    found = materialise(measures(docs, files, text), "measures")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.col(f"`{text}`").cast("string"), 256).alias("tid"))
    out = rows.join(found, "tid", "left")
    zero = F.lit(0).cast("long")
    fields = [F.coalesce(c, zero).alias(c) for c in (*SIZES, "n_best", "count_sum")]
    return out.select("row", F.struct(*fields, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")).alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = with_measures(docs)
    return slim.select("row.doc_id", *[f"found.{c}" for c in (*SIZES, "n_best", "count_sum", "groups_sha256")])
