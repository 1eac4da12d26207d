"""Column functions over text: identities, lines, tokens, probes, counts and excerpts.

All stay in the JVM but probes, counts and packed postings: an expression per character or token is interpreted there, and
costs some hundred times what the same arithmetic costs on the bytes of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tokeniser: ASCII words in lower case.
TOKEN = "[a-z0-9_]+"
UNIT_SEPARATOR = "\x1f"


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits that depend on all parts and their order."""
    joined = F.concat_ws(UNIT_SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def lines(text: Column) -> Column:
    """Physical lines; a text without a line end is one line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def tokens(text: Column) -> Column:
    """All tokens in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a lambda, an outer expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(values: Column, width: int) -> Column:
    """Space-joined runs of `width` neighbouring tokens, in order."""

    def run(v: Column) -> Column:
        last = F.size(v) - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(v, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))

    return once(values, run)


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _table(chars: str) -> np.ndarray:
    """Which of the 256 bytes are one of the ASCII characters."""
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_PROBED = _table("abcdefghijklmnopqrstuvwxyz0123456789 ")
_WORDS = _table("abcdefghijklmnopqrstuvwxyz0123456789_")


def _chunks(values: pa.Array, rows: int, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and bounds (one more than texts) of at most `rows` neighbouring texts, about `size` bytes of them or one
    text."""
    values = values.cast(pa.large_string())
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(values):
        end = min(at + rows, max(int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1, at + 1), len(values))
        yield data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def _lists(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def _probed(values: pa.Array, width: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of folded texts without nulls: how many neighbouring texts, and which of n * size hashes occur in them. Few at a time,
    so that all arrays stay in a core's cache."""
    binary = size <= 1 << 16 and size & (size - 1) == 0  # 16 bits that overflow are right then
    small, wide = (np.uint16 if binary else np.int32 if size <= 1 << 21 else np.int64), (np.int32 if size <= 1 << 21 else np.int64)
    for data, bounds in _chunks(values, max(1, (1 << 19) // size), 1 << 19):
        n = len(bounds) - 1
        kept = _PROBED[data]
        codes, ends = data[kept].astype(small), np.append(0, np.cumsum(kept, dtype=np.int32))[bounds]
        last = max(len(codes) - width + 1, 0)
        value = np.zeros(last, small)
        for k in range(width):
            value = value * small(131) + codes[k : k + last]  # below 131 * size + 256, if not in 16 bits
            value = value & small(size - 1) if binary else value % small(size)
        first = np.repeat(np.arange(n, dtype=wide) * wide(size), np.diff(ends))
        inside = first[:last] == first[width - 1 : width - 1 + last]
        seen = np.zeros(n * size, bool)
        seen[(first[:last] + value)[inside]] = True
        yield n, seen


def probe_lists(values: pa.Array, width: int, size: int) -> pa.Array:
    """Of folded texts without nulls: what probes() says."""
    parts = []
    for n, seen in _probed(values, width, size):
        found = np.flatnonzero(seen)
        ends = np.searchsorted(found, np.arange(n + 1) * size)
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found % size, pa.int32())))
    return _lists(parts, pa.int32())


def probes(text: Column, width: int = 3, size: int = 8192) -> Column:
    """Distinct hashes below `size` of the character n-grams of the folded ASCII letters, digits and spaces, ascending."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return probe_lists(values, width, size)

    return run(_folded(text))


def probe_sets(values: pa.Array, width: int, size: int) -> pa.Array:
    """Of folded texts without nulls: what probe_bits() says."""
    parts = []
    for n, seen in _probed(values, width, size):
        ends = np.arange(n + 1, dtype=np.int32) * (size // 8)
        parts.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(seen, bitorder="little"))]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def probe_bits(text: Column, width: int = 3, size: int = 8192) -> Column:
    """probes() as a set of size / 8 bytes: hash h is bit h % 8 of byte h / 8, lowest first."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return probe_sets(values, width, size)

    return run(_folded(text))


def has_probes(bits: Column, wanted: list[int]) -> Column:
    """Whether probe_bits() hold all the wanted hashes."""
    masks: dict[int, int] = {}
    for h in wanted:
        masks[h // 8] = masks.get(h // 8, 0) | 1 << h % 8
    byte = lambda at: F.conv(F.hex(F.substring(bits, at + 1, 1)), 16, 10).cast("int")
    return reduce(lambda a, b: a & b, (byte(at).bitwiseAND(F.lit(mask)) == mask for at, mask in masks.items()), F.lit(True))


def totals(values: Column) -> Column:
    """n and total of an array of integers without nulls, as a struct; in Arrow batches like probes(), so that an array made
    there does not come back."""

    @F.arrow_udf("struct<n:bigint,total:bigint>")
    def run(lists: pa.Array) -> pa.Array:
        flat = np.append(0, np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64))
        n = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(n)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(flat[ends] - flat[ends - n], pa.int64())], ["n", "total"])

    return run.asNondeterministic()(values)  # else a filter on the result computes it once more


def _begins(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in a token, and which begin one; a token ends with its text."""
    inside = _WORDS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    begins[first] = inside[first]
    return inside, begins


def n_tokens(text: Column) -> Column:
    """How many tokens a text has."""

    @F.arrow_udf("bigint")
    def run(values: pa.Array) -> pa.Array:
        found = [np.diff(np.searchsorted(np.flatnonzero(_begins(data, bounds)[1]), bounds)) for data, bounds in _chunks(values, 4096)]
        return pa.array(np.concatenate(found) if found else [], pa.int64())

    return run(_folded(text))


_COUNTED = pa.struct([("term", pa.string()), ("tf", pa.int64()), ("slot", pa.int32())])


def count_lists(values: pa.Array) -> pa.Array:
    """Of folded texts without nulls: what counts() says."""
    parts = []
    for data, bounds in _chunks(values, 4096):
        n = len(bounds) - 1
        inside, begins = _begins(data, bounds)
        starts, kept = np.flatnonzero(begins), data[inside]
        offsets = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        many = max(len(words.dictionary), 1)
        pairs, tf = np.unique((np.searchsorted(bounds, starts, "right") - 1) * many + words.indices.to_numpy(), return_counts=True)
        term = pairs % many
        slots = np.array([hashlib.sha256(w).digest()[0] for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int32)
        ends = np.searchsorted(pairs, np.arange(n + 1) * many)
        columns = [words.dictionary.take(pa.array(term, pa.int64())), pa.array(tf, pa.int64()), pa.array(slots[term], pa.int32())]
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_COUNTED))))
    return _lists(parts, _COUNTED)


def counts(text: Column) -> Column:
    """term, tf and slot (first byte of the term's SHA-256) of each distinct token of a text: array of structs, in no order."""

    @F.arrow_udf("array<struct<term:string,tf:bigint,slot:int>>")
    def run(values: pa.Array) -> pa.Array:
        return count_lists(values)

    return run(_folded(text))


#: How a posting of an integer key is laid out in bytes; the last one is for keys with nulls.
FORMS = [np.dtype(d) for d in ([("key", "<u4"), ("tf", "u1")], [("key", "<u4"), ("tf", "<u2")], [("key", "<i8"), ("tf", "<u4")], [("key", "<i8"), ("tf", "<u4"), ("null", "?")])]


def packed_schema(key: str, integer: bool) -> str:
    """Columns of packed postings: bytes laid out by FORMS for integer keys, lists for others."""
    return "term string, part int, df bigint, cf bigint, " + ("form int, packed binary" if integer else f"keys array<{key}>, tfs array<int>")


def _records(keys: pa.Array, tf: np.ndarray) -> tuple[int, np.ndarray]:
    values = keys.fill_null(0).to_numpy()
    low, high, most = (int(x) for x in (values.min(initial=0), values.max(initial=0), tf.max(initial=0)))
    form = 3 if keys.null_count else 2 if low < 0 or high >= 1 << 32 or most >= 1 << 16 else int(most >= 1 << 8)
    out = np.empty(len(values), FORMS[form])
    out["key"], out["tf"] = values, tf
    if form == 3:
        out["null"] = keys.is_null().to_numpy(zero_copy_only=False)
    return form, out


def _packed(words: pa.Array, term: np.ndarray, part: np.ndarray, keys: pa.Array, tf: np.ndarray) -> pa.RecordBatch:
    """Postings, in order of term (a place in words) and part, as one row of packed_schema() per term and part."""
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1]))) if len(term) else np.zeros(0, np.int64)
    ends = np.append(new, len(term)).astype(np.int32)
    cf = np.add.reduceat(tf, new) if len(new) else tf
    columns = {"term": words.take(pa.array(term[new], pa.int64())), "part": pa.array(part[new], pa.int32()), "df": pa.array(np.diff(ends), pa.int64()), "cf": pa.array(cf, pa.int64())}
    if pa.types.is_integer(keys.type):
        form, records = _records(keys, tf)
        columns["form"] = pa.array(np.full(len(new), form, np.int32))
        columns["packed"] = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends * np.int32(records.itemsize)), pa.py_buffer(records.view(np.uint8))])
    else:
        columns |= {name: pa.ListArray.from_arrays(pa.array(ends), v) for name, v in (("keys", keys), ("tfs", pa.array(tf, pa.int32())))}
    return pa.RecordBatch.from_pydict(columns)


def unpack(forms: np.ndarray, packed: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Of rows with form and packed: places of the rows, keys and tf of their postings, for some hundred rows at a time."""
    for at in range(0, len(packed), 256):
        for form in np.unique(forms[at : at + 256]):
            rows = np.flatnonzero(forms[at : at + 256] == form) + at
            found = packed.take(pa.array(rows))
            size = FORMS[form].itemsize
            n = np.diff(np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]) // size
            records = np.frombuffer(found.buffers()[2], FORMS[form], n.sum())
            keys = pa.array(records["key"].astype(np.int64), mask=records["null"] if form == 3 else None)
            yield np.repeat(rows, n), keys, records["tf"].astype(np.int64)


def pack_texts(values: pa.Array, keys: pa.Array, part: np.ndarray, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Postings of folded texts without nulls, a batch for about `size` bytes of them: each row has the keys of the texts of
    one part that hold a term, and how often each does."""
    at = 0
    for data, bounds in _chunks(values, len(values), size):
        n = len(bounds) - 1
        inside, begins = _begins(data, bounds)
        starts, kept = np.flatnonzero(begins), data[inside]
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, bounds)))
        offsets = np.append((np.cumsum(inside, dtype=np.int32) - 1)[starts], np.int32(len(kept)))
        found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        order = np.argsort(part[at : at + n], kind="stable")  # texts by part
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        pairs, tf = np.unique(found.indices.to_numpy().astype(np.int64) * n + place[row], return_counts=True)
        term = pairs // n
        row = order[pairs - term * n] + at
        yield _packed(found.dictionary, term, part[row], keys.take(pa.array(row)), tf)
        at += n


def pack_rows(terms: pa.Array, keys: pa.Array, tf: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Postings that are rows, packed alike."""
    found = terms.dictionary_encode()
    term = found.indices.to_numpy()
    order = np.lexsort((part, term))
    return _packed(found.dictionary, term[order], part[order], keys.take(pa.array(order)), tf[order])


def snippet(text: Column, term: str, before: int = 20, width: int = 80) -> Column:
    """An excerpt that starts up to `before` characters ahead of the first hit; null without a hit."""
    at = F.instr(F.lower(text), term)
    return F.when(at > 0, text.substr(F.greatest(at - before, F.lit(1)), F.lit(width)))


def probe_values(literal: str, width: int = 3, size: int = 8192) -> list[int]:
    """What probes() gives for a literal, on the driver."""
    codes = [ord(c) for c in literal.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 "]
    out = []
    for i in range(len(codes) - width + 1):
        value = 0
        for k in range(width):
            value = (value * 131 + codes[i + k]) % size
        out.append(value)
    return sorted(set(out))


def unicode_tokens(text: str | None, longest: int = 256) -> list[str]:
    """Distinct tokens of any script, in order: NFKC and case folded words, their parts (camel case, hyphens, digits apart),
    and the two- to four-character grams of runs of Han, kana and hangul, which have no spaces."""
    import re
    import unicodedata

    out: dict[str, None] = {}
    for word in re.findall(r"[\w$#@-]+", unicodedata.normalize("NFKC", text or "")):
        whole = word.strip("-").casefold()
        if whole and len(whole) <= longest:
            out[whole] = None
        for part in (p for run in re.findall(r"[^\W\d_]+|\d+", word) for p in re.split(r"(?<=[a-z])(?=[A-Z])", run)):
            if len(part) <= longest and part.casefold() != whole:
                out[part.casefold()] = None
            for run in re.findall(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{2,}", part):
                for n in (4, 3, 2):
                    for i in range(len(run) - n + 1):
                        out[run[i : i + n]] = None
    return list(out)


def with_unicode_tokens(docs, key: str = "doc_id", text_col: str = "text"):
    """key and terms (array) by unicode_tokens, in Arrow batches: normalisation is not a built-in function."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unicode_tokens(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, "terms"])

    schema = T.StructType([docs.schema[key], T.StructField("terms", T.ArrayType(T.StringType()))])
    return docs.select(key, text_col).mapInArrow(run, schema)
