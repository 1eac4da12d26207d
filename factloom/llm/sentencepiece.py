"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A public piece file (its path is a parameter) is read on the driver; its pieces, of fixed number, are broadcast. Texts
are cut into words where no piece can reach across: before a run of spaces, and around control characters that no
longer piece holds. The distinct words of a slice are laid out by length, and all words of one length advance
together: prefix hashes give the hash of every substring that ends at a position, a binary search in the sorted piece
keys finds its score, and vectorised maxima store the best score and a backpointer per word. A character that is no
piece costs the unknown score and becomes byte pieces.

The best segmentation is the one whose summed scores are highest. Scores of a merge-rank vocabulary (all whole and not
positive: 0, -1, -2, ...) are ranks, not log probabilities, and their sums mean nothing; such a vocabulary is scored
by -log(rank + 2.7) (Zipf-Mandelbrot), so its segmentation is the most probable one, not the merge order's. With
merges=True the file's scores are taken as what they are, an order of merges, and the ids are those that the published
tokenizer gives: the words of one length again advance together, each by its best adjacent pair at a time; a word of
more than LONG characters is merged alone from a heap.

Decoding joins pieces, turns the space mark into spaces, drops the leading one and reads byte pieces as UTF-8; it
restores every text exactly. The mark itself (U+2581) in a text is encoded as bytes, so that it survives too.

Defined results: null and empty texts have no pieces; very long words advance alone, in time linear in their length;
equal texts get equal pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.memory import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MARK_ITSELF = ""
UNKNOWN_PENALTY = 10.0
#: Characters of text whose distinct words are segmented together; words remembered between slices.
SLICE, REMEMBERED = 2_000_000, 200_000
#: Characters from which a word is merged alone.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (rows, length + 1) of rows of code points; column k is the hash of the first k."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
    return out


@dataclass
class Vocabulary:
    """pieces by id; keys are the sorted hashes of those that a text can match, with their scores and ids."""

    pieces: list[str]
    bytes_at: np.ndarray  # id of each byte's piece
    keys: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    longest: int
    unknown: float
    word: re.Pattern
    ranks: np.ndarray  # the file's own scores of keys
    merges: bool = False

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int]) -> Vocabulary:
        """special: ids that no text matches (unknown, control, bytes, unused)."""
        own = [i for i in range(len(pieces)) if i not in special and pieces[i]]
        values = np.array([scores[i] for i in own], float)
        ranks = values
        usual = values[values > -1e8]
        if len(usual) > 100 and (usual <= 0).all() and (usual == np.round(usual)).all():
            values = -np.log(np.where(values > -1e8, -values, 0.0) + 2.7)
        keys = np.array([_hashes(np.array([[ord(c) for c in pieces[i]]], np.uint64))[0, -1] for i in own], np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash or occur twice")
        loners = "".join(c for c in "\n\t\r\x0b\x0c\x00" if not any(c in pieces[i] for i in own if len(pieces[i]) > 1))
        if any(MARK in pieces[i].lstrip(MARK) for i in own):
            raise ValueError("a piece holds a space after other characters")
        lone = re.escape(loners)
        word = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|[{lone}]" if loners else ""))
        return cls(pieces, np.array([byte_ids[b] for b in range(256)], np.int32), keys[order], values[order], np.array(own, np.int32)[order], max(len(pieces[i]) for i in own), float(values.min()) - UNKNOWN_PENALTY, word, ranks[order])

    @classmethod
    def load(cls, path: str = MODEL, merges: bool = False) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in every]
        special = {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        found = cls.build(pieces, [model.get_score(i) for i in every], special, {int(pieces[i][3:5], 16): i for i in every if model.is_byte(i)})
        found.merges = merges
        return found

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of each hash; minus infinity and -1 where it is no piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.ids[at], -1)

    def _segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length, which advance together."""
        n, length, rows = len(words), len(words[0]), np.arange(len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        prefix = _hashes(codes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE, np.uint64)]))
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            sizes = np.arange(end - first, 0, -1)
            with np.errstate(over="ignore"):
                hashes = prefix[:, end : end + 1] - prefix[:, first:end] * powers[sizes]
            score, found = self._probe(hashes)
            score[:, -1] = np.where(found[:, -1] < 0, self.unknown, score[:, -1])
            total = best[:, first:end] + score
            pick = total.argmax(axis=1)
            best[:, end], back[:, end], piece[:, end] = total[rows, pick], first + pick, found[rows, pick]
        ends, steps = np.full(n, length), []
        while ends.any():
            steps.append(np.where(ends > 0, piece[rows, ends], -2))
            ends = np.where(ends > 0, back[rows, ends], 0)
        taken = np.stack(steps[::-1], axis=1)  # -2 fills the words that need fewer pieces
        out = np.split(taken[taken != -2], np.cumsum((taken != -2).sum(axis=1))[:-1])
        for r in np.flatnonzero((taken == -1).any(axis=1)):
            parts: list[list[int]] = []
            end = length
            while end:
                start = int(back[r, end])
                parts.append([int(piece[r, end])] if piece[r, end] >= 0 else self._bytes(words[r][start:end]))
                end = start
            out[r] = np.array([i for part in reversed(parts) for i in part], np.int32)
        return out

    def _rank(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The file's score of each span, minus infinity where it is no piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes) & (sizes <= self.longest), self.ranks[at], -np.inf)

    def _merged(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length by the order of merges."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        prefix, every = _hashes(codes), np.arange(n)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _BASE, np.uint64)]))

        def score(rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return self._rank(prefix[rows, end] - prefix[rows, first] * powers[end - first], end - first)

        after = np.tile(np.arange(1, length + 2), (n, 1))  # where the piece that begins here ends
        before = np.tile(np.arange(-1, length), (n, 1))
        best = np.full((n, length), -np.inf)  # of the piece that begins here with the next one
        for i in range(length - 1):
            best[:, i] = score(every, np.full(n, i), np.full(n, i + 2))
        while length > 1:
            pick = best.argmax(axis=1)
            rows = np.flatnonzero(best[every, pick] > -np.inf)
            if not len(rows):
                break
            i = pick[rows]
            middle = after[rows, i]
            end = after[rows, middle]
            after[rows, i], best[rows, middle], before[rows, end] = end, -np.inf, i
            more = end < length
            best[rows, i] = -np.inf
            best[rows[more], i[more]] = score(rows[more], i[more], after[rows[more], end[more]])
            left = before[rows, i]
            less = left >= 0
            best[rows[less], left[less]] = score(rows[less], left[less], end[less])
        out = []
        for r, w in enumerate(words):
            spans, at = [], 0
            while at < length:
                spans.append((at, int(after[r, at])))
                at = int(after[r, at])
            out.append(self._ids(w, spans, prefix[r], powers))
        return out

    def _ids(self, word: str, spans: list[tuple[int, int]], prefix: np.ndarray, powers: np.ndarray) -> np.ndarray:
        first, end = (np.array(x) for x in zip(*spans))
        with np.errstate(over="ignore"):
            _, found = self._probe(prefix[end] - prefix[first] * powers[end - first])
        if (found >= 0).all():
            return found.astype(np.int32)
        return np.array([x for (a, b), i in zip(spans, found.tolist()) for x in ([i] if i >= 0 else self._bytes(word[a:b]))], np.int32)

    def _merged_alone(self, word: str) -> np.ndarray:
        """The same for one long word, from a heap of its adjacent pairs."""
        n = len(word)
        prefix = _hashes(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(1, n).astype(np.uint64))[0]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        known = {k: v for k, v in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)} if not hasattr(self, "_known") else self._known
        self._known = known
        p, w = prefix.tolist(), powers.tolist()
        score = lambda a, b: known.get((p[b] - p[a] * w[b - a]) % 2**64) if b - a <= self.longest else None
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        heap = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := score(i, i + 2)) is not None]
        heapq.heapify(heap)
        alive = [True] * (n + 1)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if not (alive[i] and middle < n and alive[middle]) or after[i] != middle or after[middle] != end:
                continue
            after[i], alive[middle], before[end] = end, False, i
            if end < n and (s := score(i, after[end])) is not None:
                heapq.heappush(heap, (-s, i, end, after[end]))
            if before[i] >= 0 and (s := score(before[i], end)) is not None:
                heapq.heappush(heap, (-s, before[i], i, end))
        spans, at = [], 0
        while at < n:
            spans.append((at, after[at]))
            at = after[at]
        return self._ids(word, spans, prefix, powers)

    def _bytes(self, text: str) -> list[int]:
        return self.bytes_at[list(text.encode("utf-8", "surrogatepass"))].tolist()

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words of equal length are handled as one batch. The empty word stands for the mark itself."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        if MARK_ITSELF in words:
            out[words.index(MARK_ITSELF)] = np.array(self._bytes(MARK), np.int32)
        for length in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == length)
            at_once = max(1, 400_000 // int(length * min(length, self.longest)))
            for k in range(0, len(own), at_once):
                part = own[k : k + at_once]
                these = [words[i] for i in part]
                found = self._segment(these) if not self.merges else self._merged(these) if length <= LONG else map(self._merged_alone, these)
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        known: dict[str, int] = {}
        found: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        size = 0

        def answer() -> Iterator[np.ndarray]:
            if len(known) > len(found):
                found.extend(self.segment(list(known)[len(found) :]))
            for row in waiting:
                yield np.concatenate([found[i] for i in row]) if len(row) else np.empty(0, np.int32)
            waiting.clear()

        for text in texts:
            words = self._words(text or "")
            waiting.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
            size += len(text or "")
            if size > SLICE:
                yield from answer()
                size = 0
                if len(known) > REMEMBERED:
                    known, found = {}, []
        yield from answer()

    def _words(self, text: str) -> list[str]:
        """The words of a text, with its dummy space in front; a mark that the text itself holds is a word of its own."""
        if MARK not in text:
            return self.word.findall(MARK + text.replace(" ", MARK)) if text else []
        words: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            words += [MARK_ITSELF] if k else []
            words += self.word.findall(("" if k else MARK) + part.replace(" ", MARK))
        return words

    def decoder(self) -> Callable[[np.ndarray], bytes]:
        """A function from ids to the UTF-8 bytes of their text."""
        parts = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in enumerate(self.bytes_at):
            parts[i] = bytes([b])
        size = np.array([len(p) for p in parts])
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(parts), np.uint8)

        def run(ids: np.ndarray) -> bytes:
            if not len(ids):
                return b""
            n = size[ids]
            ends = np.cumsum(n)
            out = flat[np.arange(ends[-1]) + np.repeat(at[ids] - ends + n, n)].tobytes()
            return out[1:] if out[:1] == b" " else out

        return run


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", merges: bool = False) -> DataFrame:
    """id, ids (array of piece ids), n_pieces and round_trip (does decoding give the text back?) of each row.

    merges: segment by the file's order of merges, as the published tokenizer does, instead of the best summed score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, merges))  # the file's pieces, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        table = vocabulary.decoder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, same, parts, first, size = [0], [], [], 0, 0
            for k, ids in enumerate(vocabulary.encode(texts)):
                parts.append(ids)
                at.append(at[-1] + len(ids))
                same.append(table(ids) == (texts[k] or "").encode("utf-8", "surrogatepass"))
                size += len(texts[k] or "")
                if size > SLICE or k == len(texts) - 1:
                    values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k + 1 - first), values, pa.array(np.diff(at), pa.int64()), pa.array(same)], names=["id", "ids", "n_pieces", "round_trip"])
                    at, same, parts, first, size = [0], [], [], k + 1, 0

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.decoder()
        for batch in batches:
            texts = [table(np.array(ids or [], np.int32)).decode("utf-8", "surrogatepass") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, schema)
