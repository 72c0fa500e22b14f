"""Large JSON documents read in byte ranges.

A document ``{"images": [...], "annotations": [...]}`` or ``[...]`` is one value, so the line reader
cannot cut it and the whole-file reader gives it to one task. Here the text reader cuts it at every
closing brace, wherever that stands, and Spark deals the byte ranges to tasks as it does for lines. A
range does not know whether it begins within a string, nor below which brackets:

1. every range reports, for both cases, whether it ends within a string, how many brackets of earlier
   ranges it closes and which brackets it leaves open; a scan of these reports in file order, a row per
   range, gives every range the state it begins in;
2. a second read, which knows that state, cuts the elements of the top-level arrays out. An element
   that lies in one range is a row at once. Only the pieces at the ends of ranges meet by their number in the
   file.

Nothing grows with the file but the reports: about a hundred bytes for a range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.session import materialise

QUOTE, BACKSLASH, COMMA = 34, 92, 44
OPEN = {ord("{"): "{", ord("["): "["}
STEP = np.zeros(256, np.int8)
STEP[[ord(c) for c in "{["]], STEP[[ord(c) for c in "}]"]] = 1, -1

_REPORT = T.StructType().add("file", "string").add("start", "long").add("quotes", "long")
for _name in ("out", "in"):
    _REPORT = _REPORT.add(f"closed_{_name}", "long").add(f"left_{_name}", "string")
_STATE = T.StructType().add("file", "string").add("start", "long").add("in_string", "boolean").add("stack", "string")
_PIECE = T.StructType().add("file", "string").add("start", "long").add("seg", "long").add("element", "boolean")
_PIECE = _PIECE.add("gap", "long").add("head", "boolean").add("tail", "boolean").add("text", "string")


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string."""
    quote = data == QUOTE
    slash = data == BACKSLASH
    if slash.any():
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(slash, -1, at))  # last byte that is no backslash
        before = np.concatenate(([0], (at - plain)[:-1]))  # backslashes in a row just before
        quote &= before % 2 == 0
    return quote


def _scanned(data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many quotes, whether an odd number of them stands up to each byte, and the places of all brackets."""
    quote = _quotes(data)
    return int(np.count_nonzero(quote)), np.cumsum(quote, dtype=np.uint8) & 1, np.flatnonzero(STEP[data])


def _brackets(data: np.ndarray, odd: np.ndarray, at: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 for each."""
    at = at[odd[at] == in_string]
    return at, STEP[data[at]]


def _left(data: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[int, str]:
    """How many brackets from before are closed, and the brackets left open."""
    if not len(at):
        return 0, ""
    depth = np.cumsum(step)
    closed = max(0, -int(depth.min()))
    least = np.minimum.accumulate(depth[::-1])[::-1]
    still = (step > 0) & (least >= depth)
    return closed, "".join(OPEN[b] for b in data[at[still]].tolist())


def _after(stack: str, closed: int, left: str) -> str:
    return stack[: max(0, len(stack) - closed)] + left


@dataclass
class Report:
    """What a range does, begun outside and inside a string."""

    quotes: int = 0
    closed: list[int] = field(default_factory=lambda: [0, 0])
    left: list[str] = field(default_factory=lambda: ["", ""])

    def add(self, blob: bytes) -> None:
        data = np.frombuffer(blob, np.uint8)
        quotes, odd, every = _scanned(data)
        for case in (0, 1):
            closed, left = _left(data, *_brackets(data, odd, every, bool((self.quotes + case) % 2)))
            self.closed[case] += max(0, closed - len(self.left[case]))
            self.left[case] = _after(self.left[case], closed, left)
        self.quotes += quotes


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between places that follow each other with one byte between them."""
    body = np.delete(data, ends[:-1])
    offsets = np.append(starts[:1], ends)
    offsets[1:] -= np.arange(len(ends))
    texts = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends)], pa.string())
    return texts


class Cutter:
    """Cuts one range into elements of top-level arrays and the text between the arrays.

    Borders are the bracket that opens such an array, its commas, and the bracket that closes it. The text
    after border number n is segment n; what comes before the first array is segment 0, a gap."""

    def __init__(self, first: bool, in_string: bool, stack: str):
        self.in_string, self.stack = in_string, stack
        self.seg, self.head, self.parts = 0, not first, []
        self.element: bool | None = None if self.head else False
        self.gap: int | None = None if self.head else 0

    def _row(self, tail: bool) -> tuple:
        text = b"".join(self.parts).decode("utf-8", "replace")
        return self.seg, self.element, self.gap, self.head, tail, text

    def add(self, blob: bytes) -> tuple[list[tuple], list[pa.Array]]:
        """The segments that end in ``blob``: a row for the one that has begun before, and the columns ``seg, element,
        gap, text`` of all others."""
        data = np.frombuffer(blob, np.uint8)
        quotes, odd, every = _scanned(data)
        at, step = _brackets(data, odd, every, self.in_string)
        if self.stack:
            level = 2 if self.stack[0] == "{" else 1
        else:
            level = 2 if len(at) and data[at[0]] == ord("{") else 1
        depth = np.maximum(len(self.stack) + np.cumsum(step), 0)
        # a container at ``level`` counts if it is an array
        opened = at[(step > 0) & (depth == level)]
        closed = at[(step < 0) & (depth == level - 1)]
        arrays = opened[data[opened] == ord("[")]
        commas = np.flatnonzero(data == COMMA)
        commas = commas[odd[commas] == self.in_string]
        before = np.searchsorted(at, commas) - 1
        own = np.where(before >= 0, depth[np.maximum(before, 0)] if len(at) else 0, len(self.stack))
        commas = commas[own == level]
        entry = len(self.stack) >= level and self.stack[level - 1] == "["
        kinds = data[opened] == ord("[")

        def in_array(places: np.ndarray) -> np.ndarray:
            last = np.searchsorted(opened, places) - 1
            return np.where(last >= 0, kinds[np.maximum(last, 0)] if len(opened) else False, entry)

        commas, closed = commas[in_array(commas)], closed[in_array(closed)]
        self.stack = _after(self.stack, *_left(data, at, step))
        self.in_string ^= bool(quotes % 2)
        places = np.concatenate([arrays, commas, closed])
        if not len(places):
            self.parts.append(blob)
            return [], []
        order = np.argsort(places)
        places, kind = places[order], np.repeat([0, 1, 2], [len(arrays), len(commas), len(closed)])[order]
        self.parts.append(blob[: places[0]])
        begun = [self._row(False)]
        seg = self.seg + 1 + np.arange(len(places))
        gap = np.maximum.accumulate(np.where(kind == 2, seg, -1))
        gap = np.where(gap < 0, -1 if self.gap is None else self.gap, gap)
        rest = [
            pa.array(seg[:-1]), pa.array(kind[:-1] < 2), pa.array(gap[:-1], mask=gap[:-1] < 0),
            _texts(data[places[0] + 1 : places[-1]], places[:-1] - places[0], places[1:] - places[0] - 1),
        ] if len(seg) > 1 else []
        self.seg, self.head, self.parts = int(seg[-1]), False, [blob[places[-1] + 1 :]]
        self.element, self.gap = bool(kind[-1] < 2), None if gap[-1] < 0 else int(gap[-1])
        return begun, rest

    def rest(self) -> tuple:
        return self._row(True)


def _ranges(batches):
    """``file, start, blob`` of the rows that follow each other in one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, values = (batch.column(c) for c in ("file", "start", "value"))
        turns = [pc.run_end_encode(c).run_ends.to_numpy(zero_copy_only=False) for c in (file, start)]
        at = 0
        for end in np.union1d(*turns).tolist():
            rows = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), values.slice(at, end - at).cast(pa.binary()))
            yield file[at].as_py(), start[at].as_py(), pc.binary_join(rows, b"}")[0].as_py() + b"}"
            at = end


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _states(lines: DataFrame) -> DataFrame:
    """The state in which every range but the first of a file begins."""
    arrow = to_arrow_schema(_REPORT)

    def report(batches):
        known, own = None, Report()
        for file, start, blob in _ranges(batches):
            if known not in (None, (file, start)):
                yield _batch([(*known, own.quotes, own.closed[0], own.left[0], own.closed[1], own.left[1])], arrow)
                own = Report()
            known = (file, start)
            own.add(blob)
        if known:
            yield _batch([(*known, own.quotes, own.closed[0], own.left[0], own.closed[1], own.left[1])], arrow)

    def chain(table: pa.Table) -> pa.Table:
        in_string, stack, out = False, "", []
        for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
            out.append((r["file"], r["start"], in_string, stack))
            case = "in" if in_string else "out"
            stack = _after(stack, r[f"closed_{case}"], r[f"left_{case}"])
            in_string ^= bool(r["quotes"] % 2)
        return pa.Table.from_batches([_batch(out, to_arrow_schema(_STATE))])

    return lines.mapInArrow(report, _REPORT).groupBy("file").applyInArrow(chain, _STATE).filter("start > 0")


def _pieces(lines: DataFrame) -> DataFrame:
    known = {(r["file"], r["start"]): (r["in_string"], r["stack"]) for r in _states(lines).collect()}  # a row per range
    shared, arrow = lines.sparkSession.sparkContext.broadcast(known), to_arrow_schema(_PIECE)

    def cut(batches):
        at, own = None, None
        for file, start, blob in _ranges(batches):
            out = []
            if at != (file, start):
                if own:
                    out.append((*at, *own.rest()))
                at = (file, start)
                own = Cutter(start == 0, *shared.value.get(at, (False, "")))
            begun, whole = own.add(blob)
            yield _batch([*out, *[(*at, *row) for row in begun]], arrow)
            if whole:
                seg, element, gap, text = whole
                n, no = len(seg), pa.repeat(False, len(seg))
                yield pa.RecordBatch.from_arrays([pa.repeat(file, n), pa.repeat(start, n), seg, element, gap, no, no, text], schema=arrow)
        if own:
            yield _batch([(*at, *own.rest())], arrow)

    return materialise(lines.mapInArrow(cut, _PIECE), "document-pieces")


def elements(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``file, key, idx, value``: the elements, as JSON text, of the arrays that are values of a document's top
    level; ``key`` is null for a document that is an array itself. ``options`` go to the text reader.

    A document that breaks off keeps the elements that are complete. Compressed files are one range."""
    lines = spark.read.option("lineSep", "}").options(**options).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = _pieces(lines)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.filter("tail").select("file", "start", F.col("seg").alias("n"), F.col("gap").alias("last"))  # the last of a range
    offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.withColumn("entry", F.last(F.col("last") + F.col("off"), ignorenulls=True).over(before)).drop("n", "last")
    placed = pieces.join(materialise(offsets, "document-offsets"), ["file", "start"])
    placed = placed.withColumn("gap", F.coalesce(F.col("gap") + F.col("off"), "entry")).withColumn("seg", F.col("seg") + F.col("off"))
    whole = placed.filter("not head and not tail").select("file", "seg", "element", "gap", "text")
    ends = F.array_sort(F.collect_list(F.struct("start", "element", "gap", "tail", "text")))
    met = placed.filter("head or tail").groupBy("file", "seg").agg(ends.alias("p"))
    met = met.filter(~F.element_at("p", -1)["tail"])
    first = F.col("p")[0]
    met = met.select("file", "seg", first["element"].alias("element"), first["gap"].alias("gap"), F.array_join("p.text", "").alias("text"))
    met = materialise(met, "document-ends")
    every = whole.unionByName(met)
    name = F.regexp_extract("text", r'"((?:[^"\\]|\\.)*)"\s*:\s*$', 1)
    keys = every.filter("not element").select("file", F.col("seg").alias("gap"), F.nullif(name, F.lit("")).alias("key"))
    keys = materialise(keys, "document-keys")  # few beside the elements, which then need not be shuffled
    found = every.filter("element").filter(F.btrim("text", F.lit(" \t\r\n")) != "")
    return found.join(keys, ["file", "gap"]).select("file", "key", (F.col("seg") - F.col("gap") - 1).alias("idx"), F.col("text").alias("value"))


def read_array(spark: SparkSession, path: str, key: str | None, schema: str, **options: str) -> DataFrame:
    """``file``, ``idx`` and the typed fields of the elements of one top-level array."""
    own = F.col("key").isNull() if key is None else F.col("key") == key
    found = elements(spark, path, **options).filter(own)
    # generated, so that what reads several fields does not parse an element for each
    return found.select("file", "idx", F.inline(F.array(F.from_json("value", schema))))
