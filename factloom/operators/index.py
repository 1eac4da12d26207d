"""A persisted search index: built once, refreshed by segments, read by bucket.

An index is a folder of segments. Each holds `files` (key, sha256, chars, lines, n_tokens, probes: a set of bits), `postings`
(term, df, cf, and keys and tf in bytes, or in lists
where keys are no integers) partitioned by `bucket`, the first hex digits of the term's hash (one for small segments, two for
large ones), `routes` (term, df, cf) likewise, and `gone`: the keys whose rows in earlier segments no longer count. A
question reads the buckets of its own terms and nothing else; its cost grows with the postings of those terms, not with the
corpus. A row of postings holds the texts of one batch that share a term: postings are packed in the pass that counts them,
so that what is shuffled, sorted and written is a row per term and some megabytes of text. Writing is one shuffle of these
rows: each bucket is dealt by key into as many parts as the segment's characters ask for, so a term that every text holds is
spread over them, and a part is sorted by term. Texts are moved only where a key occurs twice or a refresh must choose among very many
of them. A refresh writes the texts that changed, were added or were
removed; `compact` writes all live rows as one new segment.

A segment is complete when its manifest is there (written last), whose revision is the hash of what it says; a refresh
that is run again overwrites its own segment.

Defined results: a null text has no terms; a key that occurs twice in one build or refresh counts once, with the greatest
text (or the greatest `version`, where that column is given); unknown terms are found nowhere; an empty index answers
nothing.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as X
from factloom.operators import search as S
from factloom.storage import delete, materialize, release

#: Characters of text from which a segment has 256 buckets instead of 16.
LARGE = 10_000_000_000
#: Names that are broadcast at most.
FEW = 2_000_000
#: Characters of text whose postings one task sorts and writes, on average.
PART = 20_000_000


def bucket(term: Column, digits: int) -> Column:
    """The partition of a term: the first hex digits of its CRC-32, as a number."""
    return F.shiftright(F.crc32(term.cast("binary")), 32 - 4 * digits).cast("int")


def _in_buckets(terms: Sequence[str]) -> Column:
    """The partitions that hold the terms, whatever number of digits a segment has."""
    hashes = [f"{zlib.crc32(t.encode()):08x}" for t in terms]
    return reduce(lambda a, b: a | b, ((F.col("digits") == d) & F.col("bucket").isin(*sorted({"b" + h[:d] for h in hashes})) for d in (1, 2)))


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete segments, in order."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder)]
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    return sorted(int(n.split("=")[1]) for n, p in names if n.startswith("segment=") and fs.exists(jvm.Path(p, "manifest/_SUCCESS")))


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(FEW + 1).count() <= FEW else names


def _once(docs: DataFrame, key: str) -> DataFrame:
    """One row per key: that of the greatest version, or text. Only texts whose key occurs more than once are grouped."""
    docs = docs.select(key, *(c for c in ("version", "text") if c in docs.columns))
    order = F.struct(*(F.col(c) for c in docs.columns if c != key))
    again = materialize(docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")), "index-again")
    if again.isEmpty():
        release(again)
        return docs.select(key, "text")
    again = _small(again)
    same = docs[key].eqNullSafe(again["again"])
    several = docs.join(again, same, "left_semi").groupBy(key).agg(F.max_by("text", order).alias("text"))
    return docs.join(again, same, "left_anti").select(key, "text").unionByName(several)


def _write(docs: DataFrame, gone: DataFrame | None, path: str, number: int, key: str) -> None:
    spark, folder = docs.sparkSession, f"{path}/segment={number}"
    delete(spark, folder)
    text = F.col("text")
    files = docs.select(F.col(key).alias("key"), X.content_hash(text).alias("sha256"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), F.size(X.lines(text)).cast("long").alias("lines"), X.n_tokens(text).alias("n_tokens"), X.probe_bits(text).alias("probes"))
    files.write.options(**_plain("sha256", "probes")).parquet(f"{folder}/files")
    total = _total(spark, folder)
    _write_postings(lambda parts: S.packed_postings(docs.select(F.col(key).alias("key"), "text"), "key", parts), spark, folder, total["chars"])
    (gone if gone is not None else docs.select(F.col(key).alias("key")).limit(0)).distinct().write.parquet(f"{folder}/gone")
    _write_manifest(spark, folder, {"segment": number, **total})


def _total(spark: SparkSession, folder: str) -> dict:
    """What a manifest says of the files that are written."""
    written = spark.read.parquet(f"{folder}/files")
    return written.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.bit_xor(F.xxhash64("key", "sha256")), F.lit(0)).alias("content")).first().asDict()


def _plain(*names: str) -> dict[str, str]:
    """Options of a write whose columns have hardly a value twice: no dictionary is tried for them."""
    return {f"parquet.enable.dictionary#{name}": "false" for name in names}


def _dealt(rows: DataFrame, digits: int, parts: int) -> DataFrame:
    """Every bucket in `parts` partitions; rows (term, part, ...) with their bucket instead of the part."""
    number = bucket(F.col("term"), digits)
    dealt = rows.withColumn("bucket", number).repartitionById(16**digits * parts, F.col("bucket") * parts + F.col("part"))
    name = F.concat(F.lit("b"), F.lower(F.lpad(F.hex("bucket"), digits, "0")))
    return dealt.withColumn("bucket", F.coalesce(name, F.lit(""))).drop("part")  # never null, else a writer sorts once more


def _write_postings(packed: Callable[[int], DataFrame], spark: SparkSession, folder: str, chars: int) -> None:
    """packed: S.packed_postings for a number of parts."""
    digits = 2 if chars >= LARGE else 1
    parts = max(1, -(-chars // (PART * 16**digits)))
    _dealt(packed(parts), digits, parts).sortWithinPartitions("bucket", "term").write.options(**_plain("packed")).partitionBy("bucket").parquet(f"{folder}/postings/digits={digits}")
    if posted_any(spark, folder):
        routes = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        routes = _dealt(routes.select("term", "df", "cf", F.lit(0).alias("part")), digits, 1)
        routes.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/routes/digits={digits}")


def _write_manifest(spark: SparkSession, folder: str, body: dict) -> None:
    spark.createDataFrame([(seal(body), json.dumps(body, sort_keys=True, separators=(",", ":")))], "revision string, body string").coalesce(1).write.parquet(f"{folder}/manifest")


def posted_any(spark: SparkSession, folder: str) -> bool:
    fs, postings = _fs(spark, f"{folder}/postings")
    return any(s.isDirectory() for d in fs.listStatus(postings) if d.isDirectory() for s in fs.listStatus(d.getPath()))


def seal(body: dict) -> str:
    """Hash of the canonical JSON of a manifest's body."""
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """segment, revision, body of every complete segment; raises where a revision is not its body's hash."""
    rows = [(n, *spark.read.parquet(f"{path}/segment={n}/manifest").first()) for n in segments(spark, path)]
    if any(seal(json.loads(body)) != revision for _, revision, body in rows):
        raise ValueError("a manifest does not match its revision")
    return spark.createDataFrame(rows, "segment int, revision string, body string")


def build(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """A new index of docs (key, text[, version]) at path, with one segment."""
    delete(docs.sparkSession, path)
    _write(_once(docs, key), None, path, 0, key)


def refresh(docs: DataFrame, path: str, key: str = "doc_id", removed: DataFrame | None = None, number: int | None = None) -> int:
    """Index docs that are new or whose content changed, and forget removed (key); the number of the segment.

    Rows of docs whose content the index has already are left alone. number: the segment to write, for batches that may
    be run again; segments from it on are not looked at.
    """
    spark = docs.sparkSession
    known = [n for n in segments(spark, path) if number is None or n < number]
    number = number if number is not None else (max(known) + 1 if known else 0)
    fresh = _once(docs, key)
    gone = None
    if known:
        live = live_files(spark, path, known).select("key", "sha256")
        now = fresh.select(F.col(key).alias("key"), X.content_hash(F.col("text")).alias("sha256"))
        changed = materialize(now.join(live, ["key", "sha256"], "left_anti").select("key"), "index-changed")
        few = changed.limit(FEW + 1).count() <= FEW
        fresh = fresh.join(F.broadcast(changed) if few else changed, fresh[key].eqNullSafe(changed["key"]), "left_semi")
        fresh = fresh if few else materialize(fresh, "index-fresh")  # texts that a join has moved are read three times
        gone = changed
        if removed is not None:
            gone = gone.union(removed.select(F.col(key).alias("key")))
    _write(fresh, gone, path, number, key)
    if known:
        release(changed, fresh)
    return number


def _rows(spark: SparkSession, path: str, name: str, known: Sequence[int] | None = None, wanted: Column | None = None) -> DataFrame | None:
    out = None
    for n in known if known is not None else segments(spark, path):
        folder = f"{path}/segment={n}"
        if name in ("postings", "routes") and not posted_any(spark, folder):
            continue
        part = spark.read.parquet(f"{folder}/{name}")
        part = (part if wanted is None else part.where(wanted)).withColumn("segment", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def _alive(rows: DataFrame, spark: SparkSession, path: str, known: Sequence[int] | None = None) -> DataFrame:
    """Rows whose key no later segment has taken over or removed."""
    known = list(known if known is not None else segments(spark, path))
    later = [n for n in known if n != min(known)]
    if not later:
        return rows
    gone = _rows(spark, path, "gone", later).groupBy("key").agg(F.max("segment").alias("until"))
    return rows.join(_small(gone), "key", "left").where("until is null or segment >= until").drop("until")


def live_files(spark: SparkSession, path: str, known: Sequence[int] | None = None) -> DataFrame:
    """key, sha256, chars, lines, n_tokens, probes, segment of every text in the index."""
    return _alive(_rows(spark, path, "files", known), spark, path, known)


def _posted(spark: SparkSession, path: str, known: Sequence[int] | None = None, wanted: Column | None = None) -> DataFrame | None:
    """term, key, tf of every live posting."""
    rows = _rows(spark, path, "postings", known, wanted)
    if rows is None:
        return None
    kind = _rows(spark, path, "files", known).schema["key"].dataType.simpleString()
    return _alive(S.unpacked(rows, "key", kind), spark, path, known).select("term", "key", "tf")


def postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame | None:
    """term, key, tf of the given terms: only their buckets are read."""
    return _posted(spark, path, None, _in_buckets(terms) & F.col("term").isin(*terms))


def search(spark: SparkSession, path: str, terms: Sequence[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """key, matched, score (different terms) of the texts with any term, best first, ties by key; all of them without a
    limit."""
    found = postings(spark, path, terms)
    if found is None:
        return spark.createDataFrame([], "key long, matched string, score long")
    scored = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched"), F.count(F.lit(1)).alias("score"))
    ordered = scored.orderBy(F.desc("score"), "key").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def bm25(spark: SparkSession, path: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and BM25 score, rounded to six places, of every text with any of the terms."""
    found = postings(spark, path, terms)
    files = live_files(spark, path).select("key", "n_tokens")
    corpus = files.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"))
    if found is None:
        return spark.createDataFrame([], "key long, score double")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = found.join(F.broadcast(frequency), "term").join(files, "key").crossJoin(F.broadcast(corpus))  # a row per query term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
    return joined.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))


def candidates(spark: SparkSession, path: str, literal: str) -> DataFrame:
    """Keys whose n-gram probes could hold the literal: a filter without false negatives, to be verified on the text."""
    probes = X.probe_values(literal)
    files = live_files(spark, path)
    return files.where(X.has_probes(F.col("probes"), probes)).select("key")


def locate_global(docs: DataFrame, path: str, literal: str, limit: int, after: tuple | None = None, key: str = "doc_id") -> DataFrame:
    """key, line_no, line of the lines that hold the literal, whatever its case: the next `limit` after a cursor (key,
    line_no). Texts are chosen by their probes and verified line by line."""
    chosen = candidates(docs.sparkSession, path, literal).select(F.col("key").alias(key))
    lines = docs.join(chosen, key, "left_semi").select(key, F.posexplode(X.lines(F.col("text"))).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")
    found = S.locate(lines, literal)
    if after is not None:
        found = found.where((F.col(key) > F.lit(after[0])) | ((F.col(key) == F.lit(after[0])) & (F.col("line_no") > F.lit(after[1]))))
    return found.orderBy(key, "line_no").limit(limit)


def file(spark: SparkSession, path: str, key) -> DataFrame:
    """The record of one text."""
    return live_files(spark, path).where(F.col("key") == F.lit(key))


def page_of_files(spark: SparkSession, path: str, limit: int, after=None) -> DataFrame:
    """The next texts after a key."""
    rows = live_files(spark, path).select("key", "sha256", "chars", "lines")
    return (rows if after is None else rows.where(F.col("key") > F.lit(after))).orderBy("key").limit(limit)


def posting_pages(rows: DataFrame, size: int, inline: int) -> DataFrame:
    """term, page, keys: postings as lists, cut into pages of `size` where a term has more than `inline` of them (page 0
    alone otherwise)."""
    turn = F.row_number().over(Window.partitionBy("term").orderBy("key")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy("term"))
    paged = rows.select("term", "key", F.when(total <= inline, F.lit(0)).otherwise(F.floor(turn / size)).cast("long").alias("page"))
    return paged.groupBy("term", "page").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def standing(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """One row: how the index stands to the texts: indexed, stale (other content), missing, orphaned. Reads no postings."""
    now = docs.select(F.col(key).alias("key"), X.content_hash(F.col("text")).alias("now"))
    joined = now.join(live_files(docs.sparkSession, path).select("key", "sha256"), "key", "full")
    return joined.agg(
        F.count_if(F.col("now") == F.col("sha256")).alias("indexed"), F.count_if(F.col("now") != F.col("sha256")).alias("stale"), F.count_if(F.col("sha256").isNull()).alias("missing"), F.count_if(F.col("now").isNull()).alias("orphaned"),
    )


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """One row: live terms and postings. One segment has them in its routes; of several, all postings are looked at, since
    later ones take keys away."""
    known = segments(spark, path)
    single = len(known) == 1
    rows = _rows(spark, path, "routes", known) if single else _posted(spark, path, known)
    if rows is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("terms"), F.lit(0).cast("long").alias("postings"))
    n = rows.select("term", "df") if single else rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return n.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


def coverage(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """One row: standing() and sizes()."""
    return standing(docs, path, key).crossJoin(sizes(docs.sparkSession, path))  # one row each


def compact(spark: SparkSession, path: str) -> None:
    """All live rows as one new segment; the older ones are removed once it is complete."""
    known = segments(spark, path)
    number, folder = max(known) + 1, f"{path}/segment={max(known) + 1}"
    live_files(spark, path, known).drop("segment").write.parquet(f"{folder}/files")
    alive, total = _posted(spark, path, known), _total(spark, folder)
    _write_postings(lambda parts: S.packed(alive, "key", parts), spark, folder, total["chars"])
    _rows(spark, path, "gone", known).select("key").limit(0).write.parquet(f"{folder}/gone")
    _write_manifest(spark, folder, {"segment": number, **total})
    for n in known:
        delete(spark, f"{path}/segment={n}")
