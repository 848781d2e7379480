"""Readers and writers: paged text, JSON lines, CSV worksheets, versioned snapshots, appended logs.

All listing goes through Spark's own file system, so paths may lie in any store Spark can open.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T

PAGE_MARK = r"===== PAGE ([0-9]+) ====="


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id (lower-case file stem), source_file and text of each file; subfolders are not read."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return rows.select(T.doc_id_of(name).alias("doc_id"), name.alias("source_file"), F.col("value").alias("text"))


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_no and the normalised text between page marks; text before the first mark is dropped."""
    marks = F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))
    rows = docs.select("doc_id", marks.alias("marks"), F.posexplode(F.split(text, PAGE_MARK)).alias("k", "body")).where("k > 0")
    return rows.select("doc_id", F.get("marks", F.col("k") - 1).cast("int").alias("page_no"), T.normalise_page(F.col("body")).alias("text"))


def page_faults(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose pages are not numbered 1 to N or that have text before the first page."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)), lambda x: x.cast("int"))
    wanted = F.when(F.size(marks) > 0, F.sequence(F.lit(1), F.size(marks))).otherwise(F.array().cast("array<int>"))
    return docs.where((marks != wanted) | (T.squash(F.split(text, PAGE_MARK)[0]) != "")).select("doc_id")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, one object for each row; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """Replaces a table that is read by its plain path; ``rows`` may read the old one.

    The new table is whole before the old one is moved aside, and a failed move puts the old one back, but between the two moves readers find
    none. ``publish`` has no such gap.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.tmp")
    system, at = _system(spark, path)
    old, new, aside = at(path), at(f"{path}.tmp"), at(f"{path}.old")
    system.delete(aside, True)
    had = system.exists(old) and system.rename(old, aside)
    if not system.rename(new, old):
        if had:
            system.rename(aside, old)
        raise OSError(f"cannot rename {path}.tmp")
    system.delete(aside, True)
    spark.catalog.refreshByPath(path)


#: Versions of a published table that stay, so that jobs that read an older one can end.
KEPT = 3


def publish(rows: DataFrame, path: str, keep: int = KEPT) -> str:
    """Makes ``rows`` the table at ``path`` by one atomic step; ``rows`` may read the current one. Returns the new version's folder.

    A version is written whole into a folder of its own. What makes it current is the creation of an empty file named by
    number and version, so that a reader sees the old version or the new one, and a crash at any place leaves the old one current.
    Of two writers at once the one whose mark sorts last wins. Folders that no mark names, left by crashes, are removed a day later.
    """
    spark = rows.sparkSession
    system, at = _system(spark, path)
    marks = _marks(spark, path)
    folder = mark(spark, path, lambda to: rows.write.mode("errorifexists").parquet(to))
    version = folder.rpartition("/")[2]
    now = int(time.time() * 1000)
    named = {m.split(".")[1] for m in marks[-(keep - 1) :]} | {version} if keep > 1 else {version}
    marked = {m.split(".")[1] for m in marks}
    for status in system.listStatus(at(path)):
        name = status.getPath().getName()
        if name != "_marks" and name not in named and (name in marked or now - status.getModificationTime() > 86_400_000):
            system.delete(status.getPath(), True)
    return folder


def mark(spark: SparkSession, path: str, make) -> str:
    """Lets ``make(folder)`` fill a new folder below ``path`` and then makes it the current version. Returns the folder."""
    version = uuid.uuid4().hex
    make(f"{path}/{version}")
    system, at = _system(spark, path)
    marks = _marks(spark, path)
    number = int(marks[-1].split(".")[0]) + 1 if marks else 1
    if not system.createNewFile(at(f"{path}/_marks/{number:010d}.{version}")):
        raise OSError(f"version {number} of {path} exists")
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version of a published table."""
    marks = _marks(spark, path)
    if not marks:
        raise FileNotFoundError(f"no published table at {path}")
    return f"{path}/{marks[-1].split('.')[1]}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def _marks(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in names(spark, f"{path}/_marks") if re.fullmatch(r"[0-9]{10}[.][0-9a-f]{32}", n))


def _system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and what makes a path of a text."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


HEADER, FIELD = "^## Q([0-9]+)[ \\t]*$", "^- \\*\\*([a-z0-9_]+):\\*\\* (.*)$"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """qid ({file stem}::Q{n}), md, q_num and fields of the records in the Markdown files of a folder, subfolders left out.

    The last value of a repeated field counts, lines before the first header none. Texts are single files, so their lines are one row.
    """
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    stem = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), "[.]md$", "")
    return records(rows.select(stem.alias("md"), "value"))


def records(texts: DataFrame) -> DataFrame:
    """The records of Markdown texts (md, value), as ``read_records`` gives them."""
    rows = texts.select("md", F.explode(F.split(F.replace("value", F.lit("\r\n"), F.lit("\n")), "(?m)^(?=## Q[0-9]+[ \\t]*$)")).alias("body"))
    rows = rows.select("md", F.split("body", "\n").alias("lines")).withColumn("q_num", F.regexp_extract(F.col("lines")[0], HEADER, 1)).where("q_num <> ''")
    pairs = F.transform(F.filter("lines", lambda x: x.rlike(FIELD)), lambda x: F.struct(F.regexp_extract(x, FIELD, 1).alias("k"), F.regexp_extract(x, FIELD, 2).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return rows.select(F.concat("md", F.lit("::Q"), "q_num").alias("qid"), "md", F.col("q_num").cast("int").alias("q_num"), F.map_from_entries(last).alias("fields"))


#: Kinds of questions with two passages, and without any.
TWO_SOURCES, ABSENT = 4, 5


def questions(records: DataFrame) -> DataFrame:
    """Typed questions of records: the text null is null, page lists are numbers, documents are named by their lower-case stems.

    The second passage, with its document and pages, is there for kind TWO_SOURCES alone.
    """
    value = lambda f: F.nullif(F.trim(F.col("fields")[f]), F.lit("null"))
    rows = records.withColumn("kind", value("type").cast("int"))
    second = lambda c: F.when(F.col("kind") == TWO_SOURCES, c)
    return rows.select(
        "qid", "md", "q_num", "kind", value("question").alias("question"), value("answer").alias("answer"), value("passage").alias("passage"), T.doc_id_of(value("source")).alias("doc_id"),
        T.page_list(value("page")).alias("page_list"), second(value("passage2")).alias("passage2"), second(T.doc_id_of(value("source2"))).alias("doc_id2"), second(T.page_list(value("page2"))).alias("page_list2"))


def question_faults(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(qid, fault) of questions against the documents' numbers of pages (doc_id, n_pages).

    Faults: a repeated id, a missing kind, question or answer, a passage or document that is missing or, for kind ABSENT, there, no second passage
    for TWO_SOURCES, a document that is not known, a page below 1 or beyond the last.
    """
    absent = F.col("kind") == ABSENT
    own = rows.select("qid", F.explode(F.array(*[
        F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("kind", "question", "answer")], *[
        F.when(absent & F.col(c).isNotNull(), F.lit(f"{c} of nothing")).when(~absent & F.col(c).isNull(), F.lit(f"no {c}")) for c in ("passage", "doc_id")], *[
        F.when((F.col("kind") == TWO_SOURCES) & F.col(c).isNull(), F.lit(f"no {c}")) for c in ("passage2", "doc_id2")])).alias("fault")).where("fault is not null")
    twice = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("qid", F.lit("repeated").alias("fault"))
    named = rows.select("qid", "doc_id", F.col("page_list").alias("list")).union(rows.select("qid", "doc_id2", "page_list2")).where("doc_id is not null")
    known = named.join(pages, "doc_id", "left")
    out = F.exists(F.coalesce("list", F.array().cast("array<int>")), lambda p: (p < 1) | (p > F.col("n_pages")))
    placed = known.select("qid", F.when(F.col("n_pages").isNull(), "unknown document").when(out, "page out of bounds").alias("fault")).where("fault is not null")
    return own.union(twice).union(placed).distinct()


def source_references(records: DataFrame) -> DataFrame:
    """The distinct document ids that records name as sources; null ones are left out."""
    names = records.select(F.explode(F.array(F.col("fields")["source"], F.col("fields")["source2"])).alias("source"))
    return names.where("source is not null and source <> 'null'").select(T.doc_id_of(F.trim("source")).alias("doc_id")).distinct()


def read_worksheet(spark: SparkSession, path: str, grade: str) -> DataFrame:
    """CSV rows whose grade is filled in."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).where(F.trim(grade) != "")


def write_worksheet(rows: DataFrame, path: str, grade: str) -> None:
    rows.withColumn(grade, F.lit("")).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    system, at = _system(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(at(folder))] if system.exists(at(folder)) else []


def latest(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the last file by name."""
    found = sorted(n for n in names(spark, folder) if re.fullmatch(pattern, n))
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return f"{folder}/{found[-1]}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the frozen versions v<N>."""
    return [int(m[1]) for n in names(spark, folder) if (m := re.fullmatch(r"v([0-9]+)", n))]


def latest_version(spark: SparkSession, folder: str) -> int:
    """Highest frozen version, compared as a number; 0 if there is none."""
    return max(versions(spark, folder), default=0)


def freeze(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Writes a snapshot; an existing one is never overwritten."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/v{version}/{name}")


def fingerprint(rows: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes, computed where the rows are."""
    value: Column = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 8), 16, 10).cast("long")
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0))).first())


def verify(frozen: DataFrame, now: DataFrame, key: list[str]) -> str:
    """IDENTICAL, REBUILT (same rankings, other values) or DRIFTED (other keys)."""
    moved = frozen.select(*key).exceptAll(now.select(*key)).union(now.select(*key).exceptAll(frozen.select(*key)))
    if not moved.isEmpty():
        return "DRIFTED"
    columns = sorted(frozen.columns)
    return "IDENTICAL" if fingerprint(frozen, *columns) == fingerprint(now, *columns) else "REBUILT"
