"""Language-model scoring by prediction with partial matching over bytes.

The model is a byte-context trie of order ORDER (contexts of up to five bytes, across word borders), learned from
the rows marked for training. A byte that its context has seen costs its share; otherwise an escape is paid and the
next shorter context is asked, without the symbols that the longer one has seen (symbol exclusion). Escapes are
estimated by method D: (2c - 1) / 2T for a symbol seen c times of T, d / 2T for an escape from d distinct symbols.
Below the empty context all remaining of 257 symbols (256 bytes and the end of the text) are equally likely.
mode "pretrained" scores with the trained trie; `code_length` is the adaptive form for a single text in memory.

Nothing of corpus size is ever in one place, and no text is shuffled before it is scored. A scan task cuts its rows into
chunks of bounded bytes, one after the other; a chunk's distinct grams (context and symbol, 9 bits each) and distinct
tokens go, packed, to slots: ranges of a hash of the last three context symbols, or of the token. Slots are reached
through a tree: at each level some FAN nodes are merged per slot, their counts summed, and the slot is cut into FAN finer
ones, until one node is left. So a level has FAN rows per chunk, whatever the number of chunks; the levels grow with its
logarithm; and a task holds the merged grams of one slot from some FAN nodes. In the last level all longer contexts that
end alike have met, so counts, totals and exclusions of orders 3 to 5 are complete; merged, the contexts that end in the
same three symbols have at most 257**3 grams, however common they are. Orders 0 to 2 come from the trigram counts, a table
of at most 257**3 cells whatever the corpus, which is broadcast. The costs of all grams go down the same tree, and a
chunk's texts, which were set aside with it, are scored with its own small table.

Tokens for the unigram base are maximal runs without ASCII white space and one end per text.

Defined results: ASCII letters are folded; a null text is empty and still pays its end; a null mark means training;
an empty table gives an empty result; without any training row every symbol costs log10(1/257); repeated rows count
as often as they occur; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.memory import tidy
from factloom.storage import fresh_path, release

ORDER = 5
BITS = 9
SYMBOLS = 257
GRAM, TOKEN, TOTALS, TRIGRAM, TEXT = range(5)
#: Nodes that are merged, and finer slots that a slot is cut into, from level to level.
FAN_BITS = 7
#: Tasks that the scoring is dealt into at most; beyond, a task has several chunks, one after the other.
MOST_TASKS = 100_000
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of text that are turned into grams at once.
SLICE = 1_500_000
#: A packed row; n and m are texts and words of a chunk, or n the distinct trained tokens of a slot, where kind is TOTALS.
PACKED = "kind int, node long, slot long, keys binary, counts binary, n long, m long"


def mask(order: int) -> np.int64:
    """Selects a symbol and its `order` symbols of context."""
    return np.int64((1 << BITS * (order + 1)) - 1)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty, without copying a text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each; a longer text stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram of each byte and end of the texts data[at[i]:at[i+1]], one text after the other."""
    sizes = np.diff(at)
    ids = np.repeat(np.arange(1, len(sizes) + 1) * ORDER, sizes) + np.arange(at[-1] - at[0])
    symbols = np.zeros(int(at[-1] - at[0]) + ORDER * (len(sizes) + 1), np.int64)
    symbols[ids] = FOLD[data[at[0] : at[-1]]].astype(np.int64) + 1
    code = symbols[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= symbols[ORDER - k : -k] << np.int64(BITS * k)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(sizes) + np.arange(len(sizes)) * ORDER  # where each text's end symbol stands
    for k in range(1, ORDER):
        keep[(ends + k)[ends + k < len(code)]] = False
    return code[keep]


def _slots(codes: np.ndarray, level: int, fan_bits: int) -> np.ndarray:
    """The slot, at a level, that owns the last three symbols of each gram's context."""
    context = ((codes >> np.int64(BITS)) & mask(2)).astype(np.uint64) + np.uint64(1)
    mixed = context * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - fan_bits * level)).astype(np.int64)


def _token_slots(words: list[bytes], level: int, fan_bits: int) -> np.ndarray:
    """The same for tokens, by a hash of their bytes that every process computes alike."""
    hashes = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - fan_bits * level)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, small: their differences, byte by byte, compressed."""
    steps = np.diff(values, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
    return len(values).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.T), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    steps = np.frombuffer(pa.decompress(packed[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<i8").ravel())


def _counts(counts: np.ndarray) -> bytes:
    """Counts, most of them small, compressed."""
    return len(counts).to_bytes(4, "little") + pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.copy(), codec="zstd", asbytes=True)


def _count_values(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<i8").ravel()


def _costs(values: np.ndarray) -> bytes:
    """Costs as 32-bit floats, byte by byte, compressed."""
    return len(values).to_bytes(4, "little") + pa.compress(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.copy(), codec="zstd", asbytes=True)


def _cost_values(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<f4").ravel()


def _pages(kind: int, node: int, keys, counts: np.ndarray, slots: np.ndarray) -> list[tuple]:
    """A packed row for each slot; keys keep their order."""
    order = np.argsort(slots, kind="stable")
    found, first = np.unique(slots[order], return_index=True)
    rows = []
    for slot, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        packed = b" ".join([keys[i] for i in own]) if kind == TOKEN else pack(keys[own])
        rows.append((kind, node, slot, packed, _counts(counts[own]), 0, 0))
    return rows


class _Chunk:
    """What one chunk has gathered: distinct grams and tokens with their training counts."""

    def __init__(self) -> None:
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens: Counter[bytes] = Counter()
        self.held: set[bytes] = set()
        self.texts = self.size = 0

    def add(self, data: np.ndarray, at: np.ndarray, train: np.ndarray) -> None:
        sizes = np.diff(at) + 1
        codes, learned = grams(data, at), np.repeat(train, sizes)
        self.pending += [np.unique(codes[learned], return_counts=True), (u := np.unique(codes[~learned]), np.zeros(len(u), np.int64))]
        if sum(len(c) for c, _ in self.pending) > 1_500_000:
            self.merge()
        folded = FOLD[data[at[0] : at[-1]]].tobytes()
        for i in range(len(train)):
            words = folded[at[i] - at[0] : at[i + 1] - at[0]].split()
            self.tokens.update(words) if train[i] else self.held.update(words)
        self.texts += int(train.sum())
        self.size += int(at[-1] - at[0]) + len(train)

    def merge(self) -> None:
        merged, at = np.unique(np.concatenate([self.codes, *(c for c, _ in self.pending)]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, *(n for _, n in self.pending)]), len(merged)).astype(np.int64)
        self.codes, self.pending = merged, []

    def packed(self, node: int, fan_bits: int) -> pa.RecordBatch:
        self.merge()
        rows = _pages(GRAM, node, self.codes, self.counts, _slots(self.codes, 1, fan_bits))
        learned = self.counts > 0
        three, at = np.unique(self.codes[learned] & mask(2), return_inverse=True)
        rows.append((TRIGRAM, node, 0, three.tobytes(), np.bincount(at, self.counts[learned], len(three)).astype(np.int64).tobytes(), 0, 0))
        words = list(self.tokens) + list(self.held - self.tokens.keys())
        counts = np.zeros(len(words), np.int64)
        counts[: len(self.tokens)] = list(self.tokens.values())
        rows += _pages(TOKEN, node, words, counts, _token_slots(words, 1, fan_bits)) if words else []
        rows.append((TOTALS, node, 0, b"", b"", self.texts, int(counts.sum())))
        return _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, node, slot, keys, counts, n, m = zip(*rows) if rows else [()] * 7
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), long(node), long(slot), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), long(n), long(m)], names=["kind", "node", "slot", "keys", "counts", "n", "m"])


def _gather(chunk_bytes: int, fan_bits: int):
    """Rows (id, text, train) -> chunk by chunk, its texts set aside in slices, and its packed grams and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24, _Chunk()
        for batch in batches:
            data, at = string_bytes(batch.column(1))
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(at):
                chunk.add(data, at[i : j + 1], train[i:j])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(batch.slice(i, j - i))
                yield _rows([(TEXT, node, 0, sink.getvalue().to_pybytes(), b"", 0, 0)])
                if chunk.size >= chunk_bytes:
                    yield chunk.packed(node, fan_bits)
                    node, chunk = node + 1, _Chunk()
        if chunk.size:
            yield chunk.packed(node, fan_bits)

    return run


def _merged(kind: int, keys: list[bytes], counts: list[bytes]) -> tuple:
    """(keys, summed counts) of the pages of one slot; grams are sorted."""
    if kind == GRAM:
        distinct, at = np.unique(np.concatenate([unpack(k) for k in keys]), return_inverse=True)
        return distinct, np.bincount(at, np.concatenate([_count_values(n) for n in counts]), len(distinct)).astype(np.int64)
    total: Counter[bytes] = Counter()
    for k, n in zip(keys, counts, strict=True):
        for word, c in zip(k.split(b" "), _count_values(n).tolist(), strict=True):
            total[word] += c
    return list(total), np.fromiter(total.values(), np.int64, len(total))


def _merge(level: int, fan_bits: int):
    """The pages of one node and slot -> that node's merged pages, one per slot of the next level."""

    def run(table: pa.Table) -> pa.Table:
        kind, node = table["kind"][0].as_py(), table["up"][0].as_py()
        keys, counts = _merged(kind, table["keys"].to_pylist(), table["counts"].to_pylist())
        slots = _slots(keys, level + 1, fan_bits) if kind == GRAM else _token_slots(keys, level + 1, fan_bits)
        return pa.Table.from_batches([_rows(_pages(kind, node, keys, counts, slots))])

    return run


def _spread(kind: int, keys, values: np.ndarray, nodes: list[int], slots: list[int], asked: list[bytes]) -> list[tuple]:
    """The values of the keys that each page asked for."""
    rows = []
    if kind == GRAM:
        for node, slot, k in zip(nodes, slots, asked, strict=True):
            rows.append((GRAM, node, slot, k, _costs(values[np.searchsorted(keys, unpack(k))]), 0, 0))
    else:
        known = dict(zip(keys, values.tolist(), strict=True))
        for node, slot, k in zip(nodes, slots, asked, strict=True):
            rows.append((TOKEN, node, slot, k, _counts(np.array([known[w] for w in k.split(b" ")], np.int64)), 0, 0))
    return rows


def _hand_down(key: tuple, asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers for a node's merged pages -> answers for the pages that were merged into them."""
    if not asked.num_rows:
        return pa.Table.from_batches([_rows([])])
    kind = asked["kind"][0].as_py()
    if kind == GRAM:
        keys = np.concatenate([unpack(k) for k in answers["keys"].to_pylist()])
        values = np.concatenate([_cost_values(v) for v in answers["counts"].to_pylist()])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
    else:
        keys = [w for k in answers["keys"].to_pylist() for w in k.split(b" ")]
        values = np.concatenate([_count_values(v) for v in answers["counts"].to_pylist()])
    return pa.Table.from_batches([_rows(_spread(kind, keys, values, asked["node"].to_pylist(), asked["slot"].to_pylist(), asked["keys"].to_pylist()))])


def _down(codes: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams without their oldest symbol: codes, counts, and where each of the given went."""
    shorter, at = np.unique(codes & mask(order), return_inverse=True)
    return shorter, np.bincount(at, counts, len(shorter)), at


def costs(codes: np.ndarray, counts: np.ndarray, trigrams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each of the sorted distinct grams, given their training counts and those of all trigrams.

    codes must hold every trained gram whose last three context symbols occur in it.
    """
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (codes, counts.astype(float))}
    at = {ORDER: np.arange(len(codes))}
    for k in range(ORDER - 1, -1, -1):
        shorter, sums, moved = _down(*levels[k + 1], k)
        if k == 2:  # the counts of all parts, and zeros for what only this part asks for
            every = np.union1d(trigrams[0], shorter)
            sums = np.zeros(len(every))
            sums[np.searchsorted(every, trigrams[0])] = trigrams[1]
            moved, shorter = np.searchsorted(every, shorter)[moved], every
        levels[k], at[k] = (shorter, sums), moved[at[k + 1]]
        levels[k + 1] += (moved,)
    log_p, done = np.zeros(len(codes)), np.zeros(len(codes), bool)
    excluded_sum: np.ndarray | None = None
    for k in range(ORDER, -1, -1):
        grams_k, n = levels[k][0], levels[k][1]
        contexts, node = np.unique(grams_k >> np.int64(BITS), return_inverse=True)
        total, distinct = np.bincount(node, n, len(contexts)), np.bincount(node, n > 0, len(contexts))
        mine, own = at[k], node[at[k]]
        t, d = total[own], distinct[own]
        if excluded_sum is not None:  # what the longer context has seen cannot come here
            t, d = t - excluded_sum, d - excluded_number
        c = np.where(done, 0, n[mine])
        here, pays = c > 0, ~done & (n[mine] == 0) & (t > 0.25)
        log_p[here] += np.log10((c[here] - 0.5) / t[here])
        with np.errstate(divide="ignore"):
            log_p[pays] += np.log10(d[pays] / (2 * t[pays]))
        done |= here
        if k:
            parent = levels[k][2]
            below = levels[k - 1][1][parent]
            excluded_sum = np.bincount(node, np.where(n > 0, below, 0), len(contexts))[own]
            excluded_number = distinct[own]
        else:
            rest = ~done
            log_p[rest] -= np.log10(SYMBOLS - distinct[own][rest])
    return log_p


def _learn(trigrams):
    """All pages of one slot of the last level -> the cost of each gram, or the count of each token, for each page."""

    def run(table: pa.Table) -> pa.Table:
        kind, asked = table["kind"][0].as_py(), table["keys"].to_pylist()
        keys, values = _merged(kind, asked, table["counts"].to_pylist())
        totals = []
        if kind == GRAM:
            values = costs(keys, values, trigrams.value).astype(np.float32)
        else:
            totals = [(TOTALS, -1, 0, b"", b"", int((values > 0).sum()), 0)]
        return pa.Table.from_batches([_rows(totals + _spread(kind, keys, values, table["node"].to_pylist(), table["slot"].to_pylist(), asked))])

    return run


class _Lookup:
    """Open addressing over int64 keys in numpy: a few gathers for each probe instead of a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            mine = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[mine]] = values[mine]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which must be present."""
        slot = self._slots(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def _score(key: tuple, held: pa.Table, model: pa.Table) -> pa.Table:
    """The texts of one chunk, with the costs of its grams and the counts of its tokens."""
    kind = model["kind"].to_numpy()
    packed = list(zip(model["keys"].to_pylist(), model["counts"].to_pylist(), strict=True))
    codes = [(unpack(k), _cost_values(v)) for (k, v), x in zip(packed, kind, strict=True) if x == GRAM]
    table = _Lookup(*(np.concatenate(x) for x in zip(*codes, strict=True)))
    tokens: dict[bytes, int] = {}
    for (keys, n), x in zip(packed, kind, strict=True):
        if x == TOKEN:
            tokens.update(zip(keys.split(b" "), _count_values(n).tolist(), strict=True))
    del packed, codes
    out = []
    for payload in held["keys"]:
        docs = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
        data, at = string_bytes(docs["text"])
        value = table.get(grams(data, at)).astype(np.float64)
        score = np.add.reduceat(value, (at[:-1] - at[0]) + np.arange(len(at) - 1))
        folded = FOLD[data[at[0] : at[-1]]].tobytes()
        n_tokens, n_known, log_counts = [], [], []
        for k in range(len(at) - 1):
            c = np.array([tokens[w] for w in folded[at[k] - at[0] : at[k + 1] - at[0]].split()], np.int64)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            log_counts.append(float(np.log10(c + 1.0).sum()))
        out.append(pa.Table.from_arrays([docs["id"], docs["train"], pa.array(score), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_counts, pa.float64())], names=["id", "train", "score", "n_words", "known_words", "log_counts"]))
    return pa.concat_tables(out)


def _packed(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder; its rows are large, so row groups, which readers hold whole, are short."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.row.count.limit", "16").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 12_000_000, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per input row: id, train, score (log10 probability), n_tokens, n_known, train_tokens, base_score."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    gathered = _packed(rows.mapInArrow(tidy(_gather(chunk_bytes, fan_bits)), PACKED), "ppm-chunks")
    is_kind = lambda *k: F.col("kind").isin(*k)
    chunks, texts, words = gathered.where(is_kind(TOTALS)).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["gram", "n"])

    tri = gathered.where(is_kind(TRIGRAM)).select("keys", "counts").mapInArrow(cells, "gram long, n long")
    tri = tri.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 257**3 cells
    order = np.argsort(tri["gram"].to_numpy())
    trigrams = spark.sparkContext.broadcast((tri["gram"].to_numpy()[order], tri["n"].to_numpy()[order]))

    levels, nodes = [gathered.where(is_kind(GRAM, TOKEN)).select("kind", "node", "slot", "keys", "counts")], chunks
    above = []  # the node of the next level that each level's pages go to
    while nodes > 1 << fan_bits:
        nodes = -(-nodes >> fan_bits)
        above.append(F.pmod(F.xxhash64("node"), F.lit(nodes)))
        up = levels[-1].withColumn("up", above[-1]).groupBy("kind", "up", "slot").applyInArrow(_merge(len(levels), fan_bits), PACKED)
        levels.append(_packed(up, "ppm-level").select("kind", "node", "slot", "keys", "counts"))
    answers = _packed(levels[-1].groupBy("kind", "slot").applyInArrow(_learn(trigrams), PACKED), "ppm-answers")
    distinct = answers.where(is_kind(TOTALS)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = answers.where(is_kind(GRAM, TOKEN))
    for level, up in zip(reversed(levels[:-1]), reversed(above), strict=True):
        asked = level.withColumn("up", up).groupBy("kind", "up", "slot")
        given = wanted.select("kind", F.col("node").alias("up"), F.shiftright("slot", fan_bits).alias("slot"), "keys", "counts").groupBy("kind", "up", "slot")
        lower = _packed(asked.cogroup(given).applyInArrow(_hand_down, PACKED), "ppm-answers")
        release(answers)
        answers, wanted = lower, lower

    train_tokens, kinds = words + texts, distinct + (texts > 0)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("train", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("known_words", T.LongType()), T.StructField("log_counts", T.DoubleType())])
    tasks = min(2 * chunks + 1, MOST_TASKS)  # about a chunk a task: a few chunks meet in one by chance
    held = gathered.where(is_kind(TEXT)).select("node", "keys").repartition(tasks, "node")
    wanted = wanted.select("node", "kind", "keys", "counts").repartition(tasks, "node")
    scored = held.groupBy("node").cogroup(wanted.groupBy("node")).applyInArrow(_score, schema)
    return scored.select(
        "id", "train", "score", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known_words") + F.lit(int(texts > 0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.lit(math.log10(texts + 1)) - (F.col("n_words") + 1) * F.lit(math.log10(train_tokens + kinds + 1))).alias("base_score"),
    )


def code_length(text: str, order: int = ORDER) -> float:
    """Adaptive bits of one text: the trie starts empty and learns each symbol after coding it (method D, exclusion)."""
    symbols = [b + 1 for b in FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tolist()] + [0]
    trie: dict[tuple, Counter] = {}
    bits, past = 0.0, []
    for s in symbols:
        seen: set[int] = set()
        for k in range(min(order, len(past)), -2, -1):
            if k < 0:
                bits += math.log2(SYMBOLS - len(seen))
                break
            node = {x: n for x, n in trie.get(tuple(past[len(past) - k :]), {}).items() if x not in seen}
            total = sum(node.values())
            if s in node:
                bits -= math.log2((node[s] - 0.5) / total)
                break
            if total:
                bits -= math.log2(len(node) / (2 * total))
            seen |= node.keys()
        for k in range(min(order, len(past)) + 1):
            trie.setdefault(tuple(past[len(past) - k :]), Counter())[s] += 1
        past = (past + [s])[-order:] if order else []
    return bits
