"""Manifests, gated readers and sinks. Paths are Spark's (any file system); the driver holds only manifests."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .tables import normalise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece, by the file system that Spark knows for the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if there is none of that name; whether it did. Of several writers at once one does.

    A local file appears whole, under its name, by a link, which the system makes once only. Elsewhere the file system's own creation without overwriting decides.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        if system.getUri().getScheme() == "file":
            draft = f"{path}.{uuid.uuid4().hex}"
            write_text(spark, draft, text)
            local = [jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()).toPath() for p in (path, draft)]
            try:
                jvm.java.nio.file.Files.createLink(*local)
            finally:
                system.delete(jvm.org.apache.hadoop.fs.Path(draft), False)
            return True
        stream = system.create(target, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a small document


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_manifest(spark: SparkSession, path: str, complete: bool, **facts) -> dict:
    """A JSON document of a run: names in order."""
    spec = {"complete": complete, **facts}
    write_text(spark, path, manifest_text(spec))
    return spec


def manifest_text(spec: dict) -> str:
    return json.dumps(spec, sort_keys=True, indent=2) + "\n"


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest with files: [{path, period, ...}]; an error if it is incomplete or names a period twice."""
    spec = json.loads(read_text(spark, path))
    if not spec.get("complete"):
        raise ValueError(f"the manifest is not complete: {path}")
    periods = [f["period"] for f in spec.get("files", [])]
    if len(set(periods)) < len(periods):
        raise ValueError("a period is listed twice")
    return spec


def listed(spark: SparkSession, manifests: list[str], extra: dict[str, str] | None = None) -> list[dict]:
    """The files of complete manifests, and ``extra`` ones by period; a period may come once only, so that nothing counts twice."""
    if len(set(manifests)) < len(manifests):
        raise ValueError("a manifest is given twice")
    files = [f for m in manifests for f in read_manifest(spark, m)["files"]] + [{"period": p, "path": x} for p, x in (extra or {}).items()]
    periods = [f["period"] for f in files]
    if len(set(periods)) < len(periods):
        raise ValueError("a period would count twice")
    return files


def plain_path(path: str) -> str:
    """A path without its scheme and escapes, as listed and as Spark reports it."""
    return "/" + re.sub(r"^\w+:", "", unquote(path)).strip("/")


def by_layout(spark: SparkSession, files: list[dict]) -> list[tuple[T.StructType, list[str]]]:
    """The paths of listed files by their schemas. A schema that the manifest states (as Spark's JSON) is not looked up in the file."""
    found: dict[str, tuple[T.StructType, list[str]]] = {}
    for f in files:
        schema = T.StructType.fromJson(f["schema"]) if "schema" in f else spark.read.parquet(f["path"]).schema
        found.setdefault(schema.json(), (schema, []))[1].append(f["path"])
    return list(found.values())


def open_listed(spark: SparkSession, files: list[dict], schema: T.StructType, **rules) -> DataFrame:
    """The rows of listed files or folders, each made to fit ``schema`` (columns that older files lack are null); where a manifest states a file's rows, another number is an error.

    Files of one layout are one scan, and one job counts the rows of all.
    """
    scans = [spark.read.schema(layout).parquet(*paths) for layout, paths in by_layout(spark, files)]
    if stated := {plain_path(f["path"]): f["rows"] for f in files if "rows" in f}:
        places = reduce(DataFrame.unionByName, [x.select(F.col("_metadata.file_path").alias("file")) for x in scans])
        single = [f["path"] for f in files if f["path"].endswith(".parquet")]
        at = F.when(F.substring_index("file", "/", -1).isin([x.rsplit("/", 1)[-1] for x in single]), F.col("file")).otherwise(F.regexp_replace("file", "/[^/]*$", ""))
        have: dict[str, int] = {}
        for r in places.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect():  # a row for each listed file, or folder of one
            have[plain_path(r["at"])] = r["n"]
        for path, rows in stated.items():
            n = sum(k for at, k in have.items() if at == path or at.startswith(f"{path}/"))
            if n != rows:
                raise ValueError(f"{path} has {n} rows, not {rows}")
    return reduce(DataFrame.unionByName, [normalise(x, schema, **rules) for x in scans])


#: Lines of a leaf of a file's digest.
LEAF_LINES = 100_000


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, lines and digest of the files at ``path``, which may be larger than any task's memory.

    Tasks read byte ranges of the files as lines (stretches of bytes between newlines, whatever else they hold) and hash each. Lines are numbered through the whole file by the counts of the ranges before, LEAF_LINES of them are a
    leaf, and the digest is sha256 of the file's size and its leaves' sha256 in order, so it does not depend on how the file is cut into ranges. Spark lists no empty files.
    """
    there = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))  # names and sizes only
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.sha2(F.col("value").cast("binary"), 256).alias("line"))
    lines = written(lines.withColumn("at", F.monotonically_increasing_id()))  # in order within a range
    ranges = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = lines.join(ranges, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("number"), "line")
    in_order = F.array_sort(F.collect_list(F.struct("number", "line")))  # LEAF_LINES at most
    leaves = placed.groupBy("file", F.floor(F.col("number") / LEAF_LINES).alias("leaf")).agg(F.count("*").alias("n"), in_order.alias("of"))
    leaves = leaves.select("file", "leaf", "n", F.sha2(F.array_join(F.transform("of", lambda x: x["line"]), ""), 256).alias("digest"))
    whole = leaves.groupBy("file").agg(F.sum("n").alias("lines"), F.array_sort(F.collect_list(F.struct("leaf", "digest"))).alias("of"))
    of = F.coalesce(F.array_join(F.transform("of", lambda x: x["digest"]), ""), F.lit(""))
    bare = lambda c: F.regexp_replace(c, "^\\w+:/*", "")  # noqa: E731  without the scheme
    unescaped = F.url_decode(F.regexp_replace("file", "\\+", "%2B"))
    both = there.select("bytes", F.regexp_extract("file", "[^/]+$", 0).alias("name"), bare("file").alias("key")).join(whole.withColumn("key", bare(unescaped)), "key", "left")
    return both.select("name", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"), F.sha2(F.concat(F.col("bytes").cast("string"), F.lit(":"), of), 256).alias("digest"))


def lookup_csv(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A CSV lookup by declared schema; the header line (with or without a byte order mark) gives no names. A key that repeats is an error for its rows, found where they are, not on the driver."""
    rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    names = [f.name for f in rows.schema]
    one = rows.groupBy(key).agg(F.count("*").alias("_k"), *[F.first(c).alias(c) for c in names if c != key])
    return one.withColumn(key, F.when(F.col("_k") > 1, F.raise_error(F.lit(f"{key} repeats in the lookup")).cast(rows.schema[key].dataType)).otherwise(F.col(key))).select(*names)


def write_new(df: DataFrame, path: str, *partition_by: str) -> None:
    """Accepted output is never overwritten."""
    df.write.mode("error").partitionBy(*partition_by).parquet(path)


def replace_periods(df: DataFrame, path: str, period: str) -> None:
    """Overwrites the periods that ``df`` has, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def write_split(classified: DataFrame, path: str) -> None:
    """Retained and quarantined rows in one pass, a folder for each disposition."""
    classified.write.mode("error").partitionBy("disposition").parquet(path)


def write_sorted(df: DataFrame, path: str, deal_by: str, order: list[str], *partition_by: str, row_group_bytes: int | None = None) -> None:
    """Dealt by a key and sorted within files, so that row groups hold narrow ranges of it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(parts, deal_by).sortWithinPartitions(*order).write.mode("error").partitionBy(*partition_by)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("encoding", "UTF-8").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def export_csv(df: DataFrame, path: str, max_rows: int = 100_000) -> int:
    """One CSV file with a byte order mark for a spreadsheet; a table of more than ``max_rows`` is an error, not a cut."""
    rows = df.limit(max_rows + 1).toPandas()  # max_rows + 1 rows at most
    if len(rows) > max_rows:
        raise ValueError("the table is too long for one file")
    write_text(df.sparkSession, path, "﻿" + rows.to_csv(index=False))
    return len(rows)


