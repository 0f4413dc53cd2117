"""Markdown standards as a source: recursive scan, encodings, scope by folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order they are tried, and folder names that decide a scope, first match wins.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
SCOPES = (("project", ("project", "项目")), ("department", ("department", "dept", "部门")), ("company", ("company", "enterprise", "公司")))


def decode(data: bytes) -> str | None:
    """Text in the first encoding that fits; null if none does."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def scope_of(path: Column) -> Column:
    """project, department, company or unknown, by the folders in a path."""
    low = F.lower(path)
    out = F.lit("unknown")
    for scope, names in reversed(SCOPES):
        hit = F.lit(False)
        for name in names:
            hit = hit | F.contains(low, F.lit(name))
        out = F.when(hit, scope).otherwise(out)
    return out


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, scope, size, text`` of all ``.md`` and ``.markdown`` files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.(md|markdown)$"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), texts], ["path", "size", "text"])

    read = files.select("path", "content", F.col("length").alias("size")).mapInArrow(decoded, "path string, size long, text string")
    return read.select("path", scope_of(F.col("path")).alias("scope"), "size", "text")


# The file types and folders of managed documents, and names that some systems reserve.
SUFFIXES, MANAGED_SCOPES = (".md", ".markdown"), ("company", "department", "project")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{kind}{i}" for kind in ("COM", "LPT") for i in range(1, 10)))


def managed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``scope, name, relative_path, size`` of the documents whose first folder below ``folder`` is a legal scope; contents aren't read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.(md|markdown)$"))
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    listed = files.select(relative.alias("relative_path"), F.col("length").alias("size"))
    scope = F.lower(F.element_at(F.split("relative_path", "/"), 1))
    return listed.where(F.contains("relative_path", F.lit("/")) & scope.isin(*MANAGED_SCOPES)).select(scope.alias("scope"), F.element_at(F.split("relative_path", "/"), -1).alias("name"), "relative_path", "size")


def name_problem(name: Column, most: int = 180) -> Column:
    """Why a document's name is refused; null if it isn't: a plain Markdown file name, without folders, spaces at its ends or reserved names."""
    return (
        F.when(name.isNull() | (F.length(name) == 0) | (F.length(name) > most) | F.contains(name, F.lit("\0")), "empty or too long")
        .when(name.rlike(r"^\s|\s$"), "white space at an end")
        .when(name.isin(".", "..") | name.rlike(r"[/\\:]|[. ]$"), "not a plain file name")
        .when(~F.lower(name).rlike(r"[^.]\.(md|markdown)$"), "not a Markdown file")
        .when(F.upper(F.regexp_replace(F.element_at(F.split(name, r"\."), 1), "[ .]+$", "")).isin(*RESERVED), "a reserved name")
    )


def import_problems(documents: DataFrame, existing: DataFrame, most_bytes: int = 1 << 20, marker: str = "<!-- rule ") -> DataFrame:
    """``documents`` (``scope, name, text``) with ``problem``: a bad scope, name, size or text, a repeated or existing document; null if it may be written.

    Nothing is ever overwritten: ``existing`` has ``scope, name``, compared case apart.
    """
    key = F.concat_ws("/", F.lower("scope"), F.lower("name"))
    there = existing.select(key.alias("_key")).distinct().withColumn("_there", F.lit(True))
    keyed = documents.withColumn("_key", key)
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    problem = (
        F.when(~F.coalesce(F.lower("scope").isin(*MANAGED_SCOPES), F.lit(False)), "unknown scope")
        .when(name_problem(F.col("name")).isNotNull(), name_problem(F.col("name")))
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
        .when(F.octet_length("text") > most_bytes, "too large")
        .when(F.contains("text", F.lit("\0")), "binary")
        .when(F.contains("text", F.lit(marker)), "a review document")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_there"), "exists")
    )
    return keyed.join(repeated, "_key", "left").join(there, "_key", "left").select(*documents.columns, problem.alias("problem"))


def reports(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    """The newest files below ``folder``: ``path, modified, size``, by time and then name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return files.orderBy(F.desc("modified"), "path").limit(max(0, limit))
