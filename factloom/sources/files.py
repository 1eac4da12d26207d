"""Source trees as tables: recursive scan, decoding with a named encoding, and kinds of artifact."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Suffixes that are source, folders that never are, encodings in the order they are tried, and the kinds.
SUFFIXES = tuple("cbl cob cobol cblle sqlcblle cpy copy cpb inc pco sqb src txt sql ddl dds pf lf cl clle clp jcl job".split())
IGNORED = tuple(".git .hg .svn .idea .vscode __pycache__ node_modules venv .venv".split())
COPYBOOKS, DEFINITIONS, JOBS = ("cpy", "copy", "cpb"), ("ddl", "dds", "pf", "lf"), ("cl", "clle", "clp", "jcl", "job")
ENCODINGS = ("utf-8", "cp950", "big5", "cp1252")
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
SNIFFED = 8192


def looks_binary(data: bytes) -> bool:
    """More than one null in a hundred, or one control byte in twenty (below 9, or 14 to 31), among the first bytes."""
    head = data[:SNIFFED]
    if not head or any(head.startswith(m) for m, _ in MARKS):
        return False
    control = sum(b < 32 and not 9 <= b <= 13 for b in head)
    return head.count(0) > len(head) / 100 or control > len(head) / 20


def decode(data: bytes) -> tuple[str | None, str, bool]:
    """(text, encoding, whether it is the last resort); null text for binary data, or for bytes that their own mark denies
    (encoding `damaged`)."""
    if looks_binary(data):
        return None, "binary", False
    for mark, name in MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name.removesuffix("-sig")), name, False
            except UnicodeDecodeError:
                return None, "damaged", False
    for name in ENCODINGS:
        try:
            return data.decode(name), name, False
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1", True


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, suffix, length, modified of everything below root, without reading contents; suffix '' where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def _ignored() -> Column:
    return F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")


def scan(spark: SparkSession, root: str, suffixes: Iterable[str] = SUFFIXES, extensionless: bool = False) -> DataFrame:
    """path, suffix, length, modified, sha256 and content of every source file below root; extensionless takes files
    without a suffix too. Ignored folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    wanted = suffix.isin(*suffixes, *([""] if extensionless else []))
    return files.where(wanted & ~_ignored()).select("path", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def excluded(spark: SparkSession, root: str, suffixes: Iterable[str] = SUFFIXES, extensionless: bool = False) -> DataFrame:
    """How many files were left out, by suffix and reason (ignored_folder, suffix). The contents are not read."""
    files = listing(spark, root)
    known = F.col("suffix").isin(*suffixes, *([""] if extensionless else []))
    reason = F.when(_ignored(), "ignored_folder").when(~known, "suffix")
    return files.select("suffix", reason.alias("reason")).where("reason is not null").groupBy("suffix", "reason").agg(F.count(F.lit(1)).alias("n"))


def prefix(files: DataFrame, limit: int) -> DataFrame:
    """path, the first `limit` bytes of the content, and whether that is all of it."""
    return files.select("path", F.substring("content", 1, limit).alias("head"), (F.length("content") <= limit).alias("whole"))


def verified(files: DataFrame, index: DataFrame) -> DataFrame:
    """files whose content is what the index (path, sha256) saw; the others are not to be quoted."""
    return files.where(F.sha2("content", 256) == F.col("sha256")).join(index.select("path", "sha256"), ["path", "sha256"], "left_semi")


def catalog(previous: DataFrame | None, spark: SparkSession, root: str, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """path, suffix, length, modified, sha256, origin of every source below root; what the previous catalogue has with the
    same length and time is kept (origin kept) and not read again."""
    now = listing(spark, root).where(F.col("suffix").isin(*suffixes) & ~_ignored())
    if previous is None:
        return scan(spark, root, suffixes).drop("content").withColumn("origin", F.lit("read"))
    same = ["path", "length", "modified"]
    kept = now.join(previous.select(*same, "sha256"), same).withColumn("origin", F.lit("kept"))
    paths = now.join(previous.select(*same), same, "left_anti").select("path")
    read = scan(spark, root, suffixes).join(paths, "path", "left_semi").drop("content").withColumn("origin", F.lit("read"))
    return kept.select(read.columns).unionByName(read)


def pages(lines: DataFrame, budget: int, key: str = "path") -> DataFrame:
    """key, page (from 0), start_line, end_line, text: consecutive lines packed into pages of at most `budget` characters.

    lines (key, line_no, line) of a file are packed in one fold inside its row; a line longer than the budget is a page of
    its own. A page is as long as the budget allows, so the fold is exact, not a division of running sums.
    """
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    none = F.struct(F.lit(-1).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))

    def step(done: Column, x: Column) -> Column:
        size = F.length(x["line"]) + 1
        fresh = (done["page"] < 0) | (done["used"] + size > budget)
        page = done["page"] + fresh.cast("int")
        return F.struct(page.alias("page"), F.when(fresh, size).otherwise(done["used"] + size).alias("used"), F.concat(done["at"], F.array(page)).alias("at"))

    numbered = rows.select(key, F.explode(F.arrays_zip(F.col("all"), F.aggregate("all", none, step, lambda done: done["at"]).alias("page"))).alias("x"))
    numbered = numbered.select(key, F.col("x.page").alias("page"), F.col("x.all.line_no").alias("line_no"), F.col("x.all.line").alias("line"))
    return numbered.groupBy(key, "page").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def sections(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, section, level, heading, start_line, end_line, text of Markdown-like manuals: a heading opens a section that ends
    before the next one; what stands before the first is section 0 without a heading. Lines in fences open nothing."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n", -1)).alias("at", "line"))
    node = Window.partitionBy(key).orderBy("at")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    inside = F.sum(fence.cast("int")).over(node) % 2 == 1
    mark = F.when(~inside & ~fence, F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)).otherwise("")
    opened = lines.withColumn("mark", mark).withColumn("section", F.sum((F.col("mark") != "").cast("int")).over(node))
    first = F.min(F.struct("at", "mark", "line"))
    return opened.groupBy(key, "section").agg(first.alias("f"), F.max("at").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text")).select(
        key, "section", F.length("f.mark").alias("level"), F.when(F.col("f.mark") != "", F.trim(F.regexp_replace("f.line", r"^#+\s+", ""))).alias("heading"), (F.col("f.at") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"), "text"
    )


def next_snapshot(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local and remote (path, sha256, content): the remote tree, with contents from the local one where they are the same;
    origin tells which, so only changed files are fetched."""
    kept = remote.select("path", "sha256").join(local, ["path", "sha256"]).withColumn("origin", F.lit("local"))
    fetched = remote.join(local.select("path", "sha256"), ["path", "sha256"], "left_anti").withColumn("origin", F.lit("remote"))
    return kept.select(fetched.columns).unionByName(fetched)


def put_objects(rows: DataFrame, folder: str, body: str = "body") -> DataFrame:
    """Write text bodies as content-addressed objects (partitioned by the first two digits of their hash), each once;
    returns rows with `object`, the hash, in place of the body. Writing the same content again changes nothing that is
    read."""
    named = rows.withColumn("object", F.sha2(body, 256))
    fresh = named.select("object", body).dropDuplicates(["object"]).withColumn("bucket", F.substring("object", 1, 2))
    fresh.write.mode("append").partitionBy("bucket").parquet(folder)
    return named.drop(body)


def get_objects(spark: SparkSession, folder: str, objects: list[str]) -> DataFrame:
    """object, body of the named objects: only their buckets are read, and a body that is not its name's is left out."""
    rows = spark.read.parquet(folder).where(F.col("bucket").cast("string").isin(*sorted({o[:2] for o in objects})) & F.col("object").isin(*objects))
    return rows.where(F.sha2("body", 256) == F.col("object")).select("object", "body").dropDuplicates(["object"])


def write_report(report: DataFrame, folder: str, title: str) -> None:
    """A report as JSON lines (folder/json) and as a Markdown table in text files (folder/markdown), rows in column order."""
    report.write.mode("overwrite").json(f"{folder}/json")
    cells = F.concat_ws(" | ", *(F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\\\|"), F.lit("")) for c in report.columns))
    ordered = report.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).orderBy("value")
    head = report.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(report.columns) + " |"), (3, "|" + "---|" * len(report.columns))], "n int, value string").orderBy("n").select("value")
    head.coalesce(1).union(ordered.coalesce(1)).coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def decoded(files: DataFrame) -> DataFrame:
    """path, sha256, text, encoding, used_fallback: Arrow batches, one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x or b"") for x in batch.column(2).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["path", "sha256", "text", "encoding", "used_fallback"])

    return files.select("path", "sha256", "content").mapInArrow(run, "path string, sha256 string, text string, encoding string, used_fallback boolean")


def artifact_kind(suffix: Column, text: Column) -> Column:
    """What a file is: the suffixes of copybooks, definitions and jobs decide before its text does.

    A text is a program if it names one or has code, and a fragment if it only declares data: a data division, or an
    item of level 01, 77 or 78 at the start of a line.
    """
    program = text.rlike(r"(?im)^.{0,11}(PROGRAM-ID\s*\.|\bPROCEDURE\s+DIVISION\b)")
    fragment = text.rlike(r"(?im)(^.{0,11}\bDATA\s+DIVISION\b|^\s*(01|77|78)\s+[A-Z0-9_$#@-]+\b)")
    kinds = ((suffix.isin(*COPYBOOKS), "copybook"), (suffix.isin(*DEFINITIONS), "ddl_or_db_file_definition"), (suffix.isin(*JOBS), "job_or_command"), (program, "cobol_program"), (fragment, "cobol_fragment_or_copybook"), (suffix == "sql", "sql_or_ddl"))
    chain = F
    for condition, kind in kinds:
        chain = chain.when(condition, kind)
    return chain.otherwise("unclassified_text")
