"""Quality classifier by co-training of two views.

The content view sees what a text says: hashed words and their shapes. The metadata view sees
the page around it: length, lines, line lengths, character classes, language and source.
Both are logistic regressions, fitted on a bounded sample of labelled rows. In every round
each view labels all unlabelled documents; those it is surest of go to the *other* view's training
set. Equal texts count once, and the picks of a class go round the sources and languages, so copies
or one large source cannot fill them. Features are computed once and written. At the end both
views are calibrated on held-out labels and combined, and every document is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcurate.llm.tables import small_batches
from sparkcurate.session import materialise

WORDS, META = 1024, 64  # hashed features of either view
LABELLED = 5000  # bound of the labelled sample that is fitted
ROUNDS, SURE, PICKS = 3, 0.95, 500  # least confidence, most pseudo-labels of a view and round
SLICE = 512  # rows whose features are in memory together
HELD = 1 << 16  # words whose buckets a task remembers
SALTS = 64  # parts of an origin that are ranked before the origin is
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = str.maketrans("", "", ".,;:!?\"'()-")


class _Buckets(dict):
    """Word to its bucket and the bucket of its shape; bounded, as words have no end."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > HELD:
            self.clear()
        bare = word.translate(_PLAIN)
        shape = (min(len(word), 12), word.isupper(), word.istitle(), bare.isalpha(), bare.isdigit(), word[-1].isalnum() or word[-1])
        self[word] = out = (zlib.crc32(word.encode()) % (WORDS - 192), WORDS - 192 + zlib.crc32(repr(shape).encode()) % 128)
        return out


_buckets = _Buckets()


def content_features(text: str | None) -> np.ndarray:
    """Unit vector of word and shape frequencies, with repetition of words; of nothing, zero."""
    words = _WORD.findall(text) if text else []
    out = np.zeros(WORDS)
    if not words:
        return out
    found = np.array([_buckets[w] for w in words])
    n = len(words)
    seen = np.sqrt(np.bincount(found[:, 0], minlength=WORDS - 192) / n)
    out[: WORDS - 192] = seen / np.sqrt((seen * seen).sum())
    out[WORDS - 192 : WORDS - 64] = 2 * np.bincount(found[:, 1] - (WORDS - 192), minlength=128) / n
    again = (found[1:, 0] == found[:-1, 0]).mean() if n > 1 else 0.0
    distinct = len(np.unique(found[:, 0])) / min(n, WORDS - 192)
    out[WORDS - 64 : WORDS - 61] = 2 * again, 2 * (again > 0.2), 1 - distinct
    return out


def metadata_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Layout and origin of a document; null language and source are values of their own."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(text))
    spaces = text.count(" ") + text.count("\n")
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    marks = len(re.findall(r"[#*$%&|<>!]", text))
    size = np.array([len(x) for x in lines] or [0])
    out = np.zeros(META)
    out[:9] = (
        min(1.0, np.log1p(len(text)) / 12),
        min(1.0, np.log1p(len(lines)) / 8),
        min(1.0, np.log1p(size.mean()) / 8),
        1 - len(set(lines)) / max(1, len(lines)),
        2 * letters / n,
        2 * upper / n,
        min(2.0, 10 * marks / n),
        2 * spaces / n,
        float(upper > letters / 2),
    )
    out[16 + zlib.crc32(repr(lang).encode()) % 16] = 0.2
    out[32 + zlib.crc32(repr(source).encode()) % 32] = 0.2
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32, copy=False)
    weight = np.ones(len(y)) if weight is None else weight
    weight = (weight / weight.sum()).astype(np.float32)
    rate = 1 / (0.25 * float((weight * np.einsum("ij,ij->i", x, x)).sum()) + ridge)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        slope = x.T @ (weight * (sigmoid(x @ v) - y.astype(np.float32)))
        new = v - np.float32(rate) * (slope + np.float32(ridge) * v)
        w, v = new, new + np.float32(t / (t + 3)) * (new - w)
    return w.astype(float)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of both views and of their combination; a few kilobytes."""

    content: np.ndarray
    metadata: np.ndarray
    combine: np.ndarray  # weight of the content logit, of the metadata logit, intercept
    rounds: list = field(default_factory=list)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sigmoid(logits(np.stack([logits(a, self.content), logits(b, self.metadata)], axis=1) / 4, self.combine))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, exchange, rounds: int = ROUNDS) -> Model | None:
    """Fit on labelled rows and on what ``exchange(weights, shares)`` picks for each view; None unless
    both classes are there. A fifth of the labelled rows is held out for calibration."""
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    known = y[~held].astype(float)
    train = [(v[~held], known) for v in views]
    told = []
    weights = [fit(*t) for t in train]
    for _ in range(rounds):
        extra = exchange(weights, (1 - known.mean(), known.mean()))
        if extra is None:
            break
        train = [(np.vstack([x, more]), np.concatenate([t, labels])) for (x, t), (more, labels) in zip(train, extra)]
        told.append(tuple(len(labels) for _, labels in extra[::-1]))
        weights = [fit(*t) for t in train]
    check = held if held.any() else ~held
    own = np.stack([logits(v[check], w) for v, w in zip(views, weights)], axis=1) / 4
    return Model(weights[0], weights[1], fit(own, y[check].astype(float), ridge=1e-3, steps=500), told)


def _views(rows) -> tuple[np.ndarray, np.ndarray]:
    """Both views of (text, lang, source) rows."""
    made = [(content_features(r[0]), metadata_features(*r)) for r in rows]
    if not made:
        return np.zeros((0, WORDS)), np.zeros((0, META))
    return np.stack([a for a, _ in made]), np.stack([b for _, b in made])


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows in half precision: two kilobytes each on their way to the driver."""
    return [row.tobytes() for row in x.astype(np.float16)]


def _unpacked(column) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _by_slice(score, *columns) -> np.ndarray:
    """``score`` of packed columns, unpacked ``SLICE`` rows at a time."""
    n = len(columns[0])
    parts = [score(*[_unpacked(c.iloc[at : at + SLICE]) for c in columns]) for at in range(0, n, SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _digest(text: Column, lang: Column, source: Column) -> Column:
    """Name of what the views see: equal inputs have equal features and scores."""
    seen = [F.coalesce(F.sha2(c, 256), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    return F.sha2(F.to_json(F.struct(*seen)), 256).substr(1, 32)


def _features(docs: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """``key``, a digest of what the views see, ``origin`` (of source and language) and both views as
    arrays, one row per row of ``docs``; computed on the executors and written. ``whole`` adds the
    columns of ``docs`` as ``row``, so that a verdict meets its row without a join."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(f"`{key}`").alias("key"), *[_column(docs, c).alias(c) for c in ("text", "lang", "source")], *row)
    rows = rows.withColumn("digest", _digest(F.col("text"), F.col("lang"), F.col("source"))).withColumn("origin", F.xxhash64(F.struct("source", "lang")))
    own = ["key", "digest", "origin", *(["row"] if whole else [])]
    # what stands in the row as a string is sent with the row only
    inside = {c for c in ("text", "lang", "source") if whole and c in docs.columns and docs.schema[c].dataType == T.StringType()}
    rows = rows.drop(*inside)
    shape = T.StructType([rows.schema[c] for c in own]).add("a", "binary").add("b", "binary")
    arrow = to_arrow_schema(shape)

    def compute(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                text, lang, source = (part.column("row").field(c) if c in inside else part.column(c) for c in ("text", "lang", "source"))
                a, b = _views((t.as_py(), x.as_py(), y.as_py()) for t, x, y in zip(text, lang, source))
                views = [pa.array(_packed(x), pa.binary()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*[part.column(c).cast(arrow.field(c).type) for c in own], *views], schema=arrow)

    return materialise(rows.mapInArrow(compute, shape), "features")


def _picks(every: DataFrame, known: DataFrame | None, weights: list[np.ndarray], shares: tuple[float, float], taken: list[set]) -> DataFrame:
    """``view`` that is sure, ``digest`` and ``label``: per view and class its part of ``PICKS``, the
    surest of every origin first, then the second of every origin, and so on. Digests in ``known``
    have a label; they are left out after the scores, which are smaller than the features."""

    def judge(frames):
        for frame in frames:
            for i, c in enumerate("ab"):
                p = _by_slice(lambda x: sigmoid(logits(x, weights[i])), frame[c])
                sure = np.maximum(p, 1 - p)
                ok = (sure >= SURE) & ~frame["digest"].isin(taken[1 - i]).to_numpy()
                yield pd.DataFrame({"view": i, "digest": frame["digest"][ok], "origin": frame["origin"][ok], "label": (p[ok] >= 0.5).astype(int), "sure": sure[ok]})

    found = every.select("digest", "origin", "a", "b").mapInPandas(judge, "view int, digest string, origin long, label int, sure double")
    found = found.groupBy("view", "label", "origin", "digest").agg(F.max("sure").alias("sure"))
    found = found if known is None else found.join(known, "digest", "left_anti")
    order = [F.desc("sure"), "digest"]
    # a row that is not among the first of its part is not among the first of its origin
    found = found.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    for group in (["view", "label", "origin", "salt"], ["view", "label", "origin"]):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= PICKS)
    found = materialise(found, "sure")
    parts = [
        found.filter((F.col("view") == i) & (F.col("label") == k)).orderBy("place", *order).limit(max(1, int(PICKS * shares[k])))
        for i in (0, 1)
        for k in (0, 1)
    ]
    return materialise(parts[0].union(parts[1]).union(parts[2]).union(parts[3]).select("view", "digest", "label"), "picks")


def _fitted(docs: DataFrame, labels: DataFrame, key: str, label: str, labelled: int, seed: int, whole: bool = False) -> tuple[Model | None, DataFrame]:
    """The model, and the features of all documents."""
    every = _features(small_batches(docs), key, whole)
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
    marks = marks.groupBy("key").agg(F.min("y").alias("y"))
    own = every.select("key").dropna().distinct()
    chosen = materialise(own.join(marks, "key").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(labelled), "chosen")
    got = every.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("y").alias("y"), F.min(F.struct("digest", "a", "b")).alias("f"))
    got = got.select("key", "y", "f.a", "f.b").toPandas()  # a row per chosen key: at most ``labelled``
    got = got.iloc[np.argsort([zlib.crc32(repr(k).encode()) for k in got["key"]], kind="stable")]
    if not len(got):
        return None, every
    views = tuple(_unpacked(got.pop(c)) for c in ("a", "b"))
    known = materialise(every.select("key", "digest").join(marks, "key", "left_semi").select("digest").distinct(), "known")
    taken = [set(), set()]

    def exchange(weights, shares):
        picks = _picks(every, known, weights, shares, taken)
        rows = every.join(F.broadcast(picks), "digest").groupBy("view", "label", "digest").agg(F.min("a").alias("a"), F.min("b").alias("b"))
        rows = rows.toPandas().sort_values(["view", "label", "digest"])  # at most 2 * PICKS rows, and one for a class of no share
        if not len(rows):
            return None
        out = []
        for i, c in enumerate("ab"):
            mine = rows[rows["view"] == 1 - i]
            taken[i].update(mine["digest"])
            out.append((_unpacked(mine[c]) if len(mine) else np.zeros((0, views[i].shape[1]), np.float32), mine["label"].to_numpy().astype(float)))
        return out

    return co_train(views, (got["y"].to_numpy() > 0).astype(int), exchange), every


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", labelled: int = LABELLED, seed: int = 42) -> Model | None:
    """Fit on at most ``labelled`` labelled documents, chosen by the smallest hashes of the key, and
    on pseudo-labels picked from all documents without a label. The chosen keys are a table of
    bounded size, so the features are met by a broadcast join and only those of the chosen
    reach the driver. Null labels are left out; a key with several labels counts as the lowest.
    A document of a null key has no label; a copy of a labelled one is not unlabelled."""
    return _fitted(docs, labels, key, label, labelled, seed)[0]


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of good quality; null texts are scored as empty ones. Without a
    model (no labels, or one class of them) it is null."""
    if model is None:
        return docs.withColumn(out, F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        parts = [np.zeros(0)]
        for at in range(0, len(text), 1024):
            cut = slice(at, at + 1024)
            parts.append(shared.value.score(*_views(zip(text[cut], lang[cut], source[cut]))))
        return pd.Series(np.concatenate(parts))

    return docs.withColumn(out, judged(_column(docs, text), _column(docs, "lang"), _column(docs, "source")))


def _column(docs: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None).cast("string")


KEEP = 0.5


def _judged(every: DataFrame, model: Model) -> DataFrame:
    """Written features with their ``score``."""
    shared = every.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_by_slice(shared.value.score, a, b))

    return every.withColumn("score", judged("a", "b"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that the classifier does not reject, columns as they are. Without usable
    labels nothing is rejected. Rows are written with their features and scored from there."""
    model, every = _fitted(docs, labels, key, "quality", LABELLED, 42, whole=True)
    if model is None:
        return docs
    return _judged(every, model).filter(F.col("score") >= KEEP).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, every = _fitted(docs, labels, "doc_id", "quality", LABELLED, 42)
    scored = every.withColumn("score", F.lit(None).cast("double")) if model is None else _judged(every, model)
    out = scored.select("key", "score")
    return out.select(F.col("key").alias("doc_id"), "score", F.coalesce(F.col("score") >= KEEP, F.lit(True)).alias("kept"))
