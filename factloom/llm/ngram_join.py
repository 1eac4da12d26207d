"""N-gram Jaccard join with Bayesian candidate pruning.

Each text becomes the set of hashes of its five-word shingles (words are runs without ASCII white space, ASCII
letters folded; a shorter text is one shingle) and MinHash values. Texts with equal sets form a class and go on as
one representative, so copies cost nothing further. Representatives that agree in a band of MinHash values may be
similar; bands link them to their bucket's first member, and the components of those links are groups that hold
every candidate pair. Groups are packed into blocks of bounded size; a larger group is dealt into blocks by hash and
each pair of its blocks is one task, so no task holds more than two blocks. Inside a task, each pair that shares a
band is compared MinHash chunk by MinHash chunk and dropped as soon as the posterior probability of reaching the
threshold (uniform prior) falls below the tolerance; the pairs that remain are verified exactly on the sets. Pairs
never become rows: a task returns, per representative, how many classes and documents it links to and the smallest
member it is connected with. Sums and components of these give the result.

A pair at the threshold shares no band with probability (1 - 0.8**5)**30 < 1e-5; pruning errs with at most `tolerance`
per comparison.

Defined results: a null text is empty; texts without words form one class and link to nothing else; repeated rows are
members of the same class; a null identifier is a member like any other and is named last; an empty table gives an
empty result; further columns are ignored by join_similar and kept by drop_similar, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.memory import tidy
from factloom.llm.components import components
from factloom.llm.ppm import FOLD, slices, string_bytes
from factloom.llm.rows import without
from factloom.storage import materialize, release

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
CHUNK = 15
#: Representatives in a block.
BLOCK = 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a published bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_PLACES = _mix(np.arange(100, 100 + SHINGLE, dtype=np.uint64) * _GOLD) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts data[at[i]:at[i+1]], and how many words each text has."""
    text = FOLD[data[at[0] : at[-1]]]
    inside = ~_SPACE[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = (at[:-1] - at[0])[np.diff(at) > 0]
    first[edges] = inside[edges]  # a word ends with its text
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    chars = np.flatnonzero(inside)
    begin = np.searchsorted(chars, starts)
    sizes = np.diff(np.append(begin, len(chars)))
    place = np.arange(len(chars)) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), _GOLD, np.uint64))
        words = np.add.reduceat((text[chars].astype(np.uint64) + np.uint64(1)) * powers[place], begin)
        words = _mix(words + sizes.astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, at - at[0]))


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = _word_hashes(data, at)
    edges = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE if len(rolled) else 0):
            rolled += words[k : len(words) - SHINGLE + 1 + k] * _PLACES[k]
        rolled = _mix(rolled)
        out = []
        for i, n in enumerate(counts.tolist()):
            if n >= SHINGLE:
                out.append(np.unique(rolled[edges[i] : edges[i + 1] - SHINGLE + 1]))
            elif n:
                own = words[edges[i] : edges[i + 1]]
                out.append(_mix(np.array([(own * _PLACES[:n]).sum() + np.uint64(n)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], at_once: int = 200_000) -> np.ndarray:
    """(texts, HASHES) of 32 bits; texts without shingles get zeros."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    group: list[int] = []
    size = 0
    for k, i in enumerate(full):
        group.append(i)
        size += len(sets[i])
        if size >= at_once or k == len(full) - 1:
            joined = np.concatenate([sets[j] for j in group])
            starts = np.concatenate([[0], np.cumsum([len(sets[j]) for j in group])[:-1]])
            scratch = np.empty_like(joined)
            for h in range(HASHES):
                np.multiply(joined, _MULTIPLIERS[h], out=scratch)
                out[group, h] = np.minimum.reduceat(scratch, starts) >> np.uint64(32)
            group, size = [], 0
    return out


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share, whatever their order."""
    with np.errstate(over="ignore"):
        return np.array([_mix(shingles).sum(), _mix(shingles * _GOLD + np.uint64(7)).sum()], np.uint64).tobytes() + len(shingles).to_bytes(4, "little")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = string_bytes(batch.column(2))
        for i, j in slices(at, 2_000_000):
            sets = shingle_sets(data, at[i : j + 1])
            signs = minhashes(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([x.tobytes() if len(s) else None for x, s in zip(signs, sets, strict=True)], pa.binary())], names=["id", "locator", "digest", "signs"])


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For CHUNK, 2 CHUNK, ... compared values: the fewest matches at which the posterior probability of a similarity
    of at least threshold is not below tolerance, under a uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return tuple(out)


def _survivors(signs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (left, right) survive the incremental comparison."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(step * CHUNK, (step + 1) * CHUNK)
        for some in range(0, len(alive), 200_000):
            own = alive[some : some + 200_000]
            matches[own] += (signs[left[own], part] == signs[right[own], part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair; left is sorted."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(flat.max() + 1, bool)
    out = np.zeros(len(left), np.int64)
    firsts, begin = np.unique(left, return_index=True)
    for i, b, e in zip(firsts, begin, np.append(begin[1:], len(left)), strict=True):
        marks[flat[at[i] : at[i + 1]]] = True
        for some in range(b, e, 1000):
            j = right[some : min(e, some + 1000)]
            n = sizes[j]
            ends = np.cumsum(n)
            hits = marks[flat[np.arange(ends[-1]) + np.repeat(at[j] - ends + n, n)]]
            out[some : some + len(j)] = np.add.reduceat(hits, ends - n, dtype=np.int64)
        marks[flat[at[i] : at[i + 1]]] = False
    return out


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs; with cross, only those of two sides."""
    signs = minhashes(sets)
    bands = np.ascontiguousarray(signs).view(f"V{4 * ROWS}").reshape(len(sets), BANDS)
    shared = np.zeros((len(sets), len(sets)), bool)
    for b in range(BANDS):
        _, key = np.unique(bands[:, b], return_inverse=True)
        shared |= key[:, None] == key[None, :]
    if cross:
        shared &= side[:, None] != side[None, :]
    left, right = np.nonzero(np.triu(shared, 1))
    alive = _survivors(signs, left, right, threshold, tolerance)
    left, right = left[alive], right[alive]
    if not len(left):
        return left, right
    both = _common(sets, left, right)
    sizes = np.array([len(s) for s in sets])
    good = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
    return left[good], right[good]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def _verify(threshold: float, tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        locator = table["locator"].to_numpy()
        _, first = np.unique(locator, return_index=True)  # repeated rows, in the order of their locators
        table = table.take(pa.array(first))
        locator, size, side = locator[first], table["size"].to_numpy(), table["side"].to_numpy()
        data, at = string_bytes(table["text"])
        left, right = similar_pairs(shingle_sets(data, at), side, table["cross"][0].as_py(), threshold, tolerance)
        n = len(locator)
        classes = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        documents = np.bincount(left, size[right], n) + np.bincount(right, size[left], n)
        root = locator[_roots(n, left, right)]
        return pa.Table.from_arrays([pa.array(locator), pa.array(classes.astype(np.int64)), pa.array(documents.astype(np.int64)), pa.array(root), pa.array(np.full(n, table["split"][0].as_py()))], names=["locator", "classes", "documents", "root", "split"])

    return run


def _tasks(members: DataFrame, block: int) -> DataFrame:
    """members (locator, label) -> locator, key, side, cross, split: the tasks that each representative takes part in."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = members.count()
    joined = members.join(sizes, "label")
    bins = max(1, math.ceil(2 * total / block))
    small = joined.where(F.col("n") <= block).select("locator", F.concat(F.lit("b"), F.pmod(F.xxhash64("label"), F.lit(bins))).alias("key"), F.lit(0).alias("side"), F.lit(False).alias("cross"), F.lit(False).alias("split"))
    large = joined.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("locator", F.lit(11)), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return small.union(large.select("locator", F.concat_ws("-", "label", low, high).alias("key"), (F.col("own") > F.col("other")).cast("int").alias("side"), (low < high).alias("cross"), F.lit(True).alias("split")))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, locator, class_id (first id of its component), rep_id (first id with the same
    shingles), n_links (other rows it is similar to), n_linked_classes, first (is it the component's first row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("locator"), text.alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("locator", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signs", T.BinaryType())])
    features = materialize(rows.mapInArrow(tidy(_features), schema), "join-features")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "locator")
    classes = materialize(features.groupBy("digest").agg(F.min("locator").alias("rep"), F.count(F.lit(1)).alias("size"), F.min(name).alias("name")), "join-classes")
    reps = features.where("signs is not null").join(classes.select(F.col("rep").alias("locator")), "locator", "left_semi").select("locator", "signs").dropDuplicates(["locator"])
    width = 4 * ROWS
    bands = reps.select("locator", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signs", b * width + 1, F.lit(width))))).alias("band"))
    met = bands.groupBy("band").agg(F.min("locator").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = bands.join(met, "band").select(F.col("locator").alias("a"), F.col("leader").alias("b"))
    members = components(edges).select(F.col("node").alias("locator"), "label")

    tasks = _tasks(members, block).join(classes.select(F.col("rep").alias("locator"), "size"), "locator")
    asked = rows.select("locator", "text").join(tasks, "locator")
    found = asked.select("key", "locator", "text", "size", "side", "cross", "split").groupBy("key").applyInArrow(_verify(threshold, tolerance), "locator long, classes long, documents long, root long, split boolean")
    found = materialize(found, "join-found")
    links = found.groupBy("locator").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"), F.min("root").alias("root"))
    crossing = found.where("split and root != locator").select(F.col("locator").alias("a"), F.col("root").alias("b"))
    if not crossing.isEmpty():
        across = components(crossing)
        links = links.join(across, links.locator == across.node, "left").select("locator", "classes", "documents", F.coalesce("label", "root").alias("root"))

    known = classes.join(links, classes.rep == links.locator, "left").select("digest", "size", "name", F.coalesce("root", "rep").alias("root"), F.coalesce("classes", F.lit(0)).alias("n_linked_classes"), F.coalesce("documents", F.lit(0)).alias("documents"))
    known = materialize(known, "join-known")
    firsts = known.groupBy("root").agg(F.min("name").alias("top"))
    known = known.join(firsts, "root").select("digest", "name", "top", "n_linked_classes", (F.col("documents") + F.col("size") - 1).alias("n_links"))
    return features.select("id", "locator", "digest").join(known, "digest").select(
        "id", "locator", F.col("top.id").alias("class_id"), F.col("name.id").alias("rep_id"), "n_links", "n_linked_classes", (F.col("locator") == F.col("top.locator")).alias("first")
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first row of each component, with all columns of docs; of repeated rows the first by all columns."""
    found = materialize(join_similar(docs, id_col, text_col, **options).select("id", "locator", "first"), "join-first")
    gone = materialize(found.where("not first").select("id", "locator"), "join-gone")
    repeated = materialize(found.where("first").groupBy("id", "locator").count().where("count > 1").select("id", "locator"), "join-repeated")
    release(found)
    return without(docs, gone, repeated, id_col, text_col)
