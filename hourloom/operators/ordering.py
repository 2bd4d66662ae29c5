"""Order, comparison and digests of sorted key-value tables (key, cells) as they are stored."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import keyed


def runs(stored: DataFrame, key: str = "key") -> DataFrame:
    """file, first_row, rows, first and last key of every stretch of a file that a task reads, and (with a key that is not after the one before it) key, previous and row.

    ``stored`` is a file scan; its rows are taken as they lie, without a sort. Rows of faults have no first and last.
    """
    rows = stored.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def scan(batches):
        now = None  # file, first row, rows, first key, last key of the open stretch
        fields = ["file", "first_row", "rows", "first", "last", "key", "previous", "row"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

        def out(lines):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)], names=fields)

        for batch in batches:
            key, file, row = batch.column(0), batch.column(1), batch.column(2)
            n, low = batch.num_rows, 0
            while low < n:
                name, at = file[low].as_py(), row[low].as_py()
                # rows of one file that follow each other without a gap
                same = pc.and_(pc.equal(file.slice(low), name), pc.equal(pc.subtract(row.slice(low), at), pa.array(range(n - low), pa.int64())))
                size = n - low if (stop := pc.index(same, False).as_py()) < 0 else stop
                part = key.slice(low, size)
                lines = []
                if now is not None and now[0] == name and now[1] + now[2] == at:
                    if not now[4] < part[0].as_py():
                        lines.append((name, None, None, None, None, part[0].as_py(), now[4], at))
                    now = (name, now[1], now[2] + size, now[3], part[-1].as_py())
                else:
                    if now is not None:
                        lines.append((*now, None, None, None))
                    now = (name, at, size, part[0].as_py(), part[-1].as_py())
                for i in pc.indices_nonzero(pc.less_equal(part.slice(1), part.slice(0, size - 1))).to_pylist():
                    lines.append((name, None, None, None, None, part[i + 1].as_py(), part[i].as_py(), at + i + 1))
                if lines:
                    yield out(lines)
                low += size
        if now is not None:
            yield out([(*now, None, None, None)])

    return rows.mapInArrow(scan, "file string, first_row long, rows long, first string, last string, key string, previous string, row long")


def violations(stored: DataFrame, key: str = "key") -> DataFrame:
    """key, previous, file, row and place ('inside' a file, or at the 'border' to the one before it, by the files' names) of keys that do not come after the key before them."""
    found = written(runs(stored, key))  # a row for each stretch and fault
    inside = found.where("key is not null").select("key", "previous", "file", "row", F.lit("inside").alias("place"))
    chain = Window.orderBy("file", "first_row")  # a row for each stretch that a task has read
    ends = found.where("key is null").select("file", "first_row", "first", "last")
    before = ends.withColumn("previous", F.lag("last").over(chain)).withColumn("of", F.lag("file").over(chain))
    place = F.when(F.col("file") == F.col("of"), "inside").otherwise("border")
    return inside.unionByName(before.where("previous >= first").select(F.col("first").alias("key"), "previous", "file", F.col("first_row").alias("row"), place.alias("place")))


def merged(tables: list[DataFrame]) -> DataFrame:
    """Tables stored by ``bucketed.store`` on key (of the same number of buckets) as one. A key that several tables have is an error.

    Two stored tables are walked side by side in key order, without a shuffle or sort. A third one again has no shuffle or sort of its own, but Spark deals and sorts what the
    first two gave, as an outer join states no order. (A union of the buckets would need no shuffle, but Spark 4.1 adds up columnar buckets wrongly.)
    """

    def walked(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = [t.select("key", F.col("cells").alias(c)) for t, c in ((left, "a"), (right, "b"))]
        several = F.col("a").isNotNull() & F.col("b").isNotNull()
        return a.join(b.hint("merge"), "key", "full").select(keyed.refuse(several, "a key is in several tables", F.col("key")).alias("key"), F.coalesce("a", "b").alias("cells"))

    return reduce(walked, tables)


def first_differences(left: DataFrame, right: DataFrame, span: Column | None = None) -> DataFrame:
    """For each span of keys (a column over key; the whole table without one): keys walked, keys that differ and the first of them, with the side that lacks it or 'cells'.

    Tables stored by ``bucketed.store`` on key are walked together without a shuffle or sort; what leaves a bucket is a row for each span.
    """
    a, b = [t.select("key", keyed.cells_text(F.col("cells")).alias(c)) for t, c in ((left, "a"), (right, "b"))]
    both = a.join(b.hint("merge"), "key", "full")
    fault = F.when(F.col("a").isNull(), "left").when(F.col("b").isNull(), "right").when(F.col("a") != F.col("b"), "cells")
    rows = both.select((F.lit("all") if span is None else span).alias("span"), "key", fault.alias("fault"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("key", "fault")))
    out = rows.groupBy("span").agg(F.count("*").alias("walked"), F.count("fault").alias("differing"), first.alias("first"))
    return out.select("span", "walked", "differing", F.col("first.key").alias("first_key"), F.col("first.fault").alias("first_fault"))


#: Rows of a leaf of the digest tree, and children of a node, at most; more are an error, so no group is unbounded.
MOST_CHILDREN = 10_000


def framed(text: Column) -> Column:
    """Length before value, so no two lists of values give the same text."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def row_text(cells: Column) -> Column:
    entries = F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat(framed(e["key"]), framed(e["value"])))
    return F.array_join(entries, "")


def digest_tree(table: DataFrame, prefixes: tuple[int, ...] = (10, 3, 0)) -> DataFrame:
    """level, node, rows and digest (sha256) of a tree over the keys: rows that share the first ``prefixes[0]`` characters are a leaf, nodes of the following, shorter, prefixes combine the digests below.

    Within a node all goes in the order of keys, so exchanged values change the digests above them; files and partitions do not matter. Two trees that differ show where: only in the nodes above a differing row.
    """
    if list(prefixes) != sorted(set(prefixes), reverse=True):
        raise ValueError("prefixes must get shorter")
    below = table.select("key", F.lit(1).cast("long").alias("rows"), F.sha2(F.concat(framed(F.col("key")), row_text(F.col("cells"))), 256).alias("digest"))
    levels = []
    for level, length in enumerate(prefixes):
        in_order = F.array_sort(F.collect_list(F.struct("key", "digest")))
        node = below.groupBy(F.substring("key", 1, length).alias("node")).agg(F.sum("rows").alias("rows"), F.count("*").alias("_n"), in_order.alias("_below"))
        digest = F.sha2(F.array_join(F.transform("_below", lambda x: x["digest"]), ""), 256)
        node = node.select(F.lit(level).cast("long").alias("level"), "node", "rows", keyed.refuse(F.col("_n") > MOST_CHILDREN, "a node of the digest tree has too many children", digest).alias("digest"))
        levels.append(node)
        below = node.select(F.col("node").alias("key"), "rows", "digest")
    return reduce(DataFrame.unionByName, levels)


def tree_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """level and node of all nodes in which two digest trees differ."""
    a, b = [t.select("level", "node", F.col("digest").alias(c)) for t, c in ((left, "a"), (right, "b"))]
    return a.join(b, ["level", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
