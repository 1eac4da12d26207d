"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams (2 to 6 UTF-8 bytes, ASCII and other letters in lower case, within a word and its two
borders); the value of one is the number of the text's distinct words that hold it. The model is fitted on a bounded
sample of labelled rows, drawn by hashes and written once: at most about sample_rows distinct rows and sample_bytes of
text (a text above a sixteenth of that takes no part), each with the number of times it occurs as its weight. One pass over
the sample counts, per class and bucket, in how many texts an n-gram occurs; the log ratio of the smoothed shares is its
scale r, and n-grams whose ratio is within `sure` standard errors of none get scale 0. Another fits a logistic regression on
r-scaled features by gradient steps. A tenth of the sample is held back to calibrate slope and intercept (Platt).

Scoring reads each whole text once: the distinct words of a slice of an Arrow batch are hashed together in numpy, and
a text's margin is the sum of its distinct words' values. The model is a vector of 2**bits floats, whatever the data.

Defined results: a null or empty text has no features and gets the intercept's score; rows without label or
id take no part in training; without a row of each class every score is the share of label 1 (0 if there
is no label at all); repeated rows count as often as they occur, and those of labels as often again; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.memory import tidy
from factloom.llm.rows import small
from factloom.storage import materialize, release

SHORTEST, LONGEST = 2, 6
#: Characters of text whose words are hashed together.
SLICE = 4_000_000


def _grams(words: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: buckets of the n-grams of all words with their borders, and the word of each."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))
    code = data + np.uint64(1)
    for n in range(2, LONGEST + 1):
        code = code[:-1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n >= SHORTEST:
            whole = np.flatnonzero(left[: len(code)] >= n)
            yield ((code[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32), word_of[whole]


def _slices(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[list[int]]]]:
    """Distinct words of a slice of the texts, and the distinct words of each text by number."""
    number: dict[bytes, int] = {}
    rows, size = [], 0
    for text in texts:
        words = set((text or "").lower().encode("utf-8", "surrogatepass").split())
        rows.append([number.setdefault(w, len(number)) for w in words])
        size += len(text or "")
        if size > SLICE:
            yield list(number), rows
            number, rows, size = {}, [], 0
    if rows:
        yield list(number), rows


def features_of(texts: list[str | None], bits: int, useful: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The buckets of each text, once per distinct word that holds the n-gram; only where useful, if given."""
    for words, rows in _slices(texts):
        found = [(f, w) if useful is None else (f[useful[f]], w[useful[f]]) for f, w in _grams(words, bits)] if words else []
        features, of = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32))
        features = features[np.argsort(of, kind="stable")]
        at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        for row in rows:
            ids = np.array(row, np.int64)
            counts = at[ids + 1] - at[ids]
            total = np.cumsum(counts)
            yield features[np.arange(total[-1]) + np.repeat(at[ids] - total + counts, counts)] if len(ids) else features[:0]


@dataclass
class Model:
    """score = sigmoid(slope * (sum of weights over features) + intercept)"""

    bits: int
    weights: np.ndarray
    slope: float
    intercept: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out: list[float] = []
        for words, rows in _slices(texts):
            value = np.zeros(len(words))
            for features, of in _grams(words, self.bits) if words else ():
                value += np.bincount(of, self.weights[features], len(words))
            out += [float(value[row].sum()) if row else 0.0 for row in rows]
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.intercept, -700, 700)))


def _class_counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """rows (text, label, times). Per class: texts with each bucket, and texts; a task sends at most 2**bits sums per class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            for label, times, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), features_of(batch.column(0).to_pylist(), bits), strict=True):
                row = sums[label]
                row[found] = row[found] + times  # repeated buckets are written once
                total[label] += times
        for label in (0, 1):
            at = np.flatnonzero(sums[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, label, np.int32)), pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(sums[label][at], total[label]))], names=["label", "bucket", "n"])

    counted = rows.mapInArrow(tidy(count), "label int, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label, bucket, n = (counted.column(i).to_numpy() for i in range(3))
    sums, total = np.zeros((2, 1 << bits)), np.zeros(2)
    here = bucket >= 0
    sums[label[here], bucket[here]] = n[here]
    total[label[~here]] = n[~here]
    return sums, total


def _sampled(rows: DataFrame, bits: int, useful: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """rows (text, label, turn, times): the useful features, label and weight of each, in the order of turn."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in features_of(batch.column(0).to_pylist(), bits, useful)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2), batch.column(3)], names=["f", "label", "turn", "times"])

    got = rows.mapInArrow(extract, "f binary, label int, turn long, times long").toArrow()
    taken = sorted(zip(*(got.column(i).to_pylist() for i in (2, 0, 1, 3)), strict=True))
    return [np.frombuffer(f, np.int32) for _, f, _, _ in taken], np.array([y for _, _, y, _ in taken], float), np.array([t for *_, t in taken], float)


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample_rows: int, sample_bytes: int) -> DataFrame:
    """text, label, turn, times of a bounded number of distinct labelled rows, as a written table."""
    wanted = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id", "label").agg(F.count(F.lit(1)).alias("times"))
    share = lambda n, most: int(1_000_000 * min(1.0, most / max(1, n)))
    drawn = materialize(wanted.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share(wanted.count(), sample_rows)), "tox-drawn")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text")).where(F.octet_length("text") <= sample_bytes // 16).join(small(drawn), "id")
    rows = rows.select("text", "label", F.xxhash64("id", "text", "label").alias("turn"), "times")
    found = materialize(rows.groupBy("turn", "label").agg(F.first("text").alias("text"), F.sum("times").alias("times")), "tox-found")
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    release(drawn)
    if n <= 2 * sample_rows and size <= sample_bytes:
        return found
    least = min(share(n, sample_rows), share(size, sample_bytes))  # an id of many different texts, or long ones
    fewer = materialize(found.where(F.pmod(F.xxhash64("turn", F.lit(8)), F.lit(1_000_000)) < least), "tox-found")
    release(found)
    return fewer


def _fit(found: list[np.ndarray], labels: np.ndarray, times: np.ndarray, ratio: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on r-scaled features by full-batch Adam steps; returns r * w and the intercept."""
    at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    columns = np.concatenate(found) if found else np.empty(0, np.int32)
    used, columns = np.unique(columns, return_inverse=True)
    rows = np.repeat(np.arange(len(found)), np.diff(at))
    r = ratio[used]
    values = r[columns]
    w, b = np.full(len(used), 0.1), -2.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(rows, values * w[columns], len(found)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * times / times.sum()
        g = np.bincount(columns, values * error[rows], len(used)) + decay * w / times.sum()
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = r * w
    return weights, float(b)


def _calibrate(margins: np.ndarray, labels: np.ndarray, times: np.ndarray, intercept: float) -> tuple[float, float]:
    """Platt's slope and intercept by Newton steps, with his smoothed targets."""
    ones = (labels * times).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (times.sum() - ones + 2))
    a, b = 1.0, intercept
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = times * (p - target), times * (p * (1 - p) + 1e-9)
        ga, gb, haa, hab, hbb = (d * margins).sum(), d.sum(), (h * margins * margins).sum() + 1e-6, (h * margins).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, intercept)


def log_ratio(sums: np.ndarray, total: np.ndarray, sure: float) -> np.ndarray:
    """The naive Bayes log-count ratio of each bucket; 0 within `sure` standard errors of none."""
    ratio = np.log((sums[1] + 0.5) / (total[1] + 1)) - np.log((sums[0] + 0.5) / (total[0] + 1))
    error = np.sqrt(1 / (sums[1] + 0.5) + 1 / (sums[0] + 0.5))
    return np.where(np.abs(ratio) < sure * error, 0.0, ratio)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = 18, sample_rows: int = 12_000, sample_bytes: int = 64_000_000, sure: float = 4.0, rounds: int = 200, rate: float = 0.05, decay: float = 0.02) -> Model:
    """Fit on docs joined with labels by id; about sample_rows distinct labelled rows and sample_bytes of text at most."""
    rows = _sample(docs, labels, label_col, id_col, text_col, sample_rows, sample_bytes)
    sums, total = _class_counts(rows.select("text", "label", "times"), bits)
    if total.min() == 0:
        share = total[1] / max(1.0, total.sum())
        release(rows)
        return Model(bits, np.zeros(1 << bits, np.float32), 1.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratio = log_ratio(sums, total, sure)
    found, y, times = _sampled(rows.select("text", "label", "turn", "times"), bits, ratio != 0)
    release(rows)
    cut = len(found) // 10
    if not 0 < y[cut:].sum() < len(y) - cut:
        cut = 0
    weights, intercept = _fit(found[cut:], y[cut:], times[cut:], ratio, rounds, rate, decay)
    margins = np.array([weights[f].sum(dtype=np.float64) for f in found])
    held = slice(0, cut) if 0 < y[:cut].sum() < cut else slice(None)
    slope, intercept = _calibrate(margins[held], y[held], times[held], intercept)
    return Model(bits, weights, slope, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the data

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], names=["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(apply), schema)
