"""Quality by co-training of two views.

The content view sees measures of the text alone: shares of character classes, repeated and distinct words, word and
line lengths. The metadata view sees source, language and length, never the text. Each view is a logistic regression
on the labelled rows; over some rounds each labels the unlabelled rows that it is surest of, in the classes' own
proportion, and hands them to the other view. At the end each view is calibrated (Platt) on labelled rows that neither
has trained on, and a document's score is the mean of the two calibrated log odds, weighted by how much each lowers
the held rows' log loss; a view that helps nothing gets no weight.

Training uses a bounded sample (at most about sample_rows labelled and as many unlabelled distinct rows, drawn by hashes of
the identifier and of the whole row, each with the number of times it occurs as its weight) whose few measures, never a
text, go to the driver; scoring is one pass in Arrow batches without a shuffle. The model is two small
vectors: sources and languages are hashed into a fixed number of buckets.

Defined results: a null or empty text has zero measures; null source or language is a value of its own; repeated rows
count as often as they occur; without a row of each class every score is the share of label 1 (1 without any label,
so that nothing is rejected); an empty table gives an empty result; further columns are kept by keep_good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.memory import tidy
from factloom.llm.ppm import slices, string_bytes
from factloom.llm.rows import small
from factloom.storage import materialize, release

# Character classes of the content view, by byte.
LOWER, UPPER, DIGIT, BLANK, LINE, COMMON, SYMBOL, OTHER = range(8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[:128] = SYMBOL
CLASS[97:123], CLASS[65:91], CLASS[48:58] = LOWER, UPPER, DIGIT
CLASS[[9, 11, 12, 32]], CLASS[[10, 13]] = BLANK, LINE
CLASS[[ord(c) for c in ".,;:'\"()?-"]] = COMMON
BUCKETS = 64
MEASURES = 16
WINDOW = 25


def content_view(texts: pa.Array) -> np.ndarray:
    """(rows, MEASURES) of measures of each text, some texts at a time."""
    data, at = string_bytes(texts)
    return np.concatenate([np.zeros((0, MEASURES)), *(_measures(data, at[i : j + 1]) for i, j in slices(at))])


def _measures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    n = np.maximum(size, 1)
    out = np.zeros((len(size), MEASURES))
    kind = CLASS[data[at[0] : at[-1]]]
    edges = at - at[0]
    for c in range(8):
        total = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)])
        out[:, c] = (total[edges[1:]] - total[edges[:-1]]) / n
    exclaims = np.concatenate([[0], np.cumsum(data[at[0] : at[-1]] == 33, dtype=np.int64)])
    out[:, 8] = (exclaims[edges[1:]] - exclaims[edges[:-1]]) / n
    whole = data[at[0] : at[-1]].tobytes()
    for i in range(len(size)):
        words = whole[edges[i] : edges[i + 1]].split()
        if words:
            m = len(words)
            out[i, 9] = sum(map(eq, words, words[1:])) / m
            # distinct words in windows of one size, so that long texts do not look repetitive; a window counts by its words
            held = [(len(set(words[k : k + WINDOW])), min(WINDOW, m - k)) for k in range(0, m, WINDOW)]
            out[i, 10] = sum(d for d, _ in held) / m
            out[i, 11] = sum(n for d, n in held if 2 * d < n) / m
            out[i, 12] = min(size[i] / m, 40) / 10
            out[i, 13] = sum(w.isalpha() or not w.isascii() for w in words) / m
            out[i, 14] = sum(len(w) == 1 for w in words) / m
            out[i, 15] = min(3.0, 10 * out[i, LINE] * size[i] / m)
    return out


def metadata_view(source: pa.Array, lang: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one-hot places of source, language and length, as (rows, 3) columns, all with value one."""
    _, at = string_bytes(texts)
    place = lambda name, x, k: k * BUCKETS + zlib.crc32(f"{name}={x}".encode()) % BUCKETS
    length = np.minimum(2 * np.log2(np.diff(at) + 1), BUCKETS - 1).astype(np.int64)
    columns = np.empty((len(texts), 3), np.int64)
    columns[:, 0] = [place("source", x, 0) for x in source.to_pylist()]
    columns[:, 1] = [place("lang", x, 1) for x in lang.to_pylist()]
    columns[:, 2] = 2 * BUCKETS + length
    return columns


def one_hot(columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(columns), 3 * BUCKETS))
    out[np.arange(len(columns))[:, None], columns] = 1
    return out


@dataclass
class View:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights + self.intercept

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


@dataclass
class Model:
    content: View | None
    metadata: View | None
    prior: float

    def scores(self, content: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.content is None:
            same = np.full(len(content), self.prior)
            return same, same, same
        a, b = self.content.calibrated(content), self.metadata.calibrated(one_hot(columns))
        return _sigmoid(self.content.share * a + self.metadata.share * b), _sigmoid(a), _sigmoid(b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _solve(x: np.ndarray, y: np.ndarray, decay: float, rounds: int = 30, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) of a weighted logistic regression, by Newton steps."""
    times = np.ones(len(x)) if times is None else times
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], decay)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        gradient = x.T @ (times * (p - y)) + ridge * w
        step = np.linalg.solve((x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray, plain: bool, times: np.ndarray | None = None) -> View:
    times = np.ones(len(x)) if times is None else times
    mean, spread = np.zeros(x.shape[1]), np.ones(x.shape[1])
    if not plain:
        mean = times @ x / times.sum()
        spread = np.sqrt(times @ (x - mean) ** 2 / times.sum()) + 1e-6
    w = _solve(np.clip((x - mean) / spread, -6, 6), y, 3.0, times=times)
    return View(mean, spread, w[:-1], float(w[-1]))


def co_train(content: np.ndarray, columns: np.ndarray, labels: np.ndarray, rounds: int = 4, grow: float = 0.05, times: np.ndarray | None = None) -> Model:
    """labels: 1, 0, or -1 where unknown. Each round hands over the surest `grow` of the unlabelled rows per view; times
    are the rows' weights."""
    times = np.ones(len(labels)) if times is None else times.astype(float)
    known = np.flatnonzero(labels >= 0)
    prior = float(np.average(labels[known], weights=times[known])) if len(known) else 1.0
    if len(known) < 10 or prior in (0.0, 1.0):
        return Model(None, None, prior)
    views = [content, one_hot(columns)]
    held, base = known[::5], np.setdiff1d(known, known[::5])
    if len(set(labels[base])) < 2 or len(set(labels[held])) < 2:
        held = base = known
    unknown = np.flatnonzero(labels < 0)
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has received
    fitted: list[View] = []
    for turn in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            rows = np.concatenate([base, np.array(list(given[v]), np.int64)])
            y = np.concatenate([labels[base], np.array(list(given[v].values()), np.int64)])
            fitted.append(_fit(views[v][rows], y.astype(float), v == 1, times[rows]))
        if turn == rounds or not len(unknown):
            break
        for v in (0, 1):
            other = given[1 - v]
            left = np.array([i for i in unknown if i not in other], np.int64)
            if not len(left):
                continue
            p = _sigmoid(fitted[v].logit(views[v][left]))
            order = np.argsort(p, kind="stable")
            ones, zeros = int(len(unknown) * grow * prior), int(len(unknown) * grow * (1 - prior))
            for i in order[::-1][:ones]:
                if p[i] > 0.9:
                    other[int(left[i])] = 1
            for i in order[:zeros]:
                if p[i] < 0.1:
                    other[int(left[i])] = 0
    y, own = labels[held].astype(float), times[held]
    loss = lambda z: float(np.average(np.log1p(np.exp(-np.clip(np.where(y == 1, z, -z), -30, 30))), weights=own))
    ones, every = float(own @ y), float(own.sum())
    blank = loss(np.full(len(y), np.log((ones / every + 1e-9) / (1 - ones / every + 1e-9))))
    soft = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (every - ones + 2))  # Platt's targets
    for v in (0, 1):
        w = _solve(fitted[v].logit(views[v][held])[:, None], soft, 0.01, times=own)
        fitted[v].slope, fitted[v].shift = max(0.0, float(w[0])), float(w[1])
    gains = [max(0.0, blank - loss(fitted[v].calibrated(views[v][held]))) for v in (0, 1)]
    for v in (0, 1):
        fitted[v].share = gains[v] / sum(gains) if sum(gains) else 0.5
    return Model(fitted[0], fitted[1], prior)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 10_000, rounds: int = 4) -> Model:
    """Co-train on docs and their labels, by id; about sample_rows distinct labelled and unlabelled rows each at most."""
    wanted = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id", "label").agg(F.count(F.lit(1)).alias("times"))
    part = lambda n: int(1_000_000 * min(1.0, sample_rows / max(1, n)))
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000))
    drawn = materialize(wanted.where(chance("id", F.lit(9)) < part(wanted.count())), "quality-drawn")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs["source"], docs["lang"])
    turn = F.xxhash64("id", "text", "source", "lang")  # a hash of the whole row, so rows without an id are drawn one by one
    named = rows.join(small(drawn), "id").select(turn.alias("turn"), "text", "source", "lang", "label", "times")
    plain = rows.where(F.pmod(F.xxhash64(turn, F.lit(13)), F.lit(1_000_000)) < part(docs.count())).join(wanted.select("id"), "id", "left_anti")
    plain = plain.select(turn.alias("turn"), "text", "source", "lang", F.lit(-1).alias("label"), F.lit(1).cast("long").alias("times"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, columns = content_view(batch.column(1)), metadata_view(batch.column(2), batch.column(3), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in columns], pa.binary()), batch.column(5)], names=["turn", "label", "content", "columns", "times"])

    measured = named.union(plain).mapInArrow(tidy(measure), "turn long, label int, content binary, columns binary, times long")
    measured = materialize(measured.groupBy("turn", "label", "content", "columns").agg(F.sum("times").alias("times")), "quality-sample")
    most = measured.count()
    if most > 4 * sample_rows:  # an id of many different rows
        measured = measured.where(chance("turn", "label", F.lit(17)) < int(1_000_000 * 2 * sample_rows / most))
    got = measured.toArrow()
    release(drawn, measured)
    if not got.num_rows:
        return Model(None, None, 1.0)
    order = sorted(range(got.num_rows), key=lambda i, t=got["turn"].to_pylist(), y=got["label"].to_pylist(): (t[i], y[i]))
    got = got.take(pa.array(order))
    content = np.stack([np.frombuffer(x) for x in got["content"].to_pylist()])
    columns = np.stack([np.frombuffer(x, np.int64) for x in got["columns"].to_pylist()])
    return co_train(content, columns, got["label"].to_numpy(), rounds, times=got["times"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of good quality) and each view's own probability, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(content_view(batch.column(1)), metadata_view(batch.column(2), batch.column(3), batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found)], names=["id", "score", "content_score", "metadata_score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.DoubleType()) for c in ("score", "content_score", "metadata_score"))])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs["source"], docs["lang"]).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least `least`, with all columns."""

    places = [docs.columns.index(c) for c in (text_col, "source", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang = (batch.column(i) for i in places)
            found = model.scores(content_view(text), metadata_view(source, lang, text))[0]
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(tidy(run), docs.schema)
