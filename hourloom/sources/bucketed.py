"""Tables stored in buckets of a key, each one sorted file, so that later joins, windows and groups on the key neither shuffle nor sort."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir

#: Spark trusts the order of a bucket only with this setting, and only where a bucket is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Spark leaves buckets unused where it sees no need for them; two tables that are read side by side need them.
AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
#: Spark 4.1 takes a union of buckets for dealt by their key, but lays columnar ones end to end, so groups over it come out in parts.
UNION = "spark.sql.unionOutputPartitioning"


def store(df: DataFrame, by: str, order: list[str], buckets: int | None = None, name: str = "bucketed") -> DataFrame:
    """``df`` stored by ``by`` and sorted by ``order``, read back. Dealt by the hash that buckets use, so one task writes a bucket's one file.

    The files are an external table in the shared folder; the session's catalog knows it by a name of its own.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = shared_dir(spark, name), f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, by).sortWithinPartitions(*order)
    dealt.write.option("path", path).option("maxRecordsPerFile", 0).bucketBy(buckets, by).sortBy(*order).saveAsTable(table)
    return open_table(spark, table)


def open_table(spark: SparkSession, table: str) -> DataFrame:
    spark.conf.set(ORDERED, "true")
    spark.conf.set(AUTO, "false")
    spark.conf.set(UNION, "false")
    return spark.table(table)
