"""Line deduplication by an exact set-similarity join (operator 10).

Lines are sets of words (A-Z lowered, split at white space), ordered by rarity; blocks of lines that share a token of their
prefixes come from ``setjoin``. A line with an earlier line of Jaccard similarity 0.8 or more is removed, whether or not that earlier
line is removed itself, so the result does not depend on any order of work. Earlier means a smaller (doc_id, hash of the text,
line number). In a block the length filter, the positional filter and a bitmap choose pairs. Each line's most promising
partner is verified on whole sets before the others, which decides most copies; in blocks where some line had more, lines still open then
meet all others of the block, in tiles: the best of each tile, then, for lines still open, all that pass.

Lines of fewer than ``least`` different words are left alone; with 1 only lines without words are. Null texts have no lines and stay null. Rows that are equal in
id and text are the same document: equal lines of both stay or go together. A document that loses lines keeps the others, joined by \\n; a very long
text takes memory in proportion to itself; an empty table gives an empty result. Extra columns are untouched, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .setjoin import best_of, blocks, distinct, frequent_arrays, may_match, scan, sets_of, signatures, verified, word_hashes

#: Smaller sets have no similarity of 0.8 with any other set, so only equal ones go, by their key.
PAIRED = 4
#: Lines of a tile of a large block, how many partners of a line are tried first, in its block and in each tile, and how many a block sends with its line at most; the rest meet in tiles.
TILE, FIRST, TILE_FIRST, MANY = 500, 1, 2, 32


def line_units(texts: list[str]):
    """A unit for each line."""
    lines = [t.split("\n") for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    line = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.zeros(0, np.int64)
    h, sizes = word_hashes([x for ls in lines for x in ls])
    owner, token = distinct(np.repeat(np.arange(len(text)), sizes), h)
    return text, line, owner, token


def tile_pairs(members: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) that pass the filters: lines that have more partners than were sent and are not gone, with the other lines of their block, tile by tile.

    members: t, tiles, k, n, p, s, more, gone. most: only so many for each line and tile, those that may share most.
    """
    cols = ["t", "tile", "side", "k", "n", "p", "s"]
    all_lines = members.withColumn("side", F.lit(0)).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    open_lines = members.where("more and gone is null").withColumn("side", F.lit(1)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = all_lines.select(*cols).unionByName(open_lines.select(*cols)).repartition(parts, "t", "tile").sortWithinPartitions("t", "tile", "side")

    def partners(x: np.ndarray, y: np.ndarray, k: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, p, s = cols
        i, j = np.nonzero((k[y] != k[x][:, None]) & may_match(n[x][:, None], n[y], p[x][:, None], p[y], s[x][:, None], s[y]))
        i, j = x[i], y[j]
        if most is not None and len(i):
            kept = best_of(i, j, np.bitwise_count(s[i] ^ s[j]).astype(np.int64), most) < most
            i, j = i[kept], j[kept]
        return i, j

    def run(batches):
        held = None  # lines of the open tile; the open lines that come after them pass by
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t, tile, side, k, n, p, s = [table.column(c).to_numpy() for c in ("t", "tile", "side", "k", "n", "p", "s")]
            cols = [n.astype(np.int64), p.astype(np.int64), s.view(np.uint64)]
            edge = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (tile[1:] != tile[:-1])))
            for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(t)], strict=True):
                middle = low + int((side[low:high] == 0).sum())
                y = np.arange(low, middle)
                for at in range(middle, high, 256):
                    i, j = partners(np.arange(at, min(at + 256, high)), y, k, cols)
                    if len(i):
                        pair = np.unique(np.stack([np.maximum(k[i], k[j]), np.minimum(k[i], k[j])]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])
            low = int(edge[-1])
            held = table.slice(low, int((side[low:] == 0).sum())).combine_chunks()

    return dealt.mapInArrow(run, "a long, b long")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """doc_id, h and line of the lines that go."""
    rows = scan(docs, id_col, text_col)
    found, counts = signatures(rows, line_units, least)
    lines = found.where("k is not null").select("doc_id", "h", "line", "k")
    first = written(lines.groupBy("k").agg(F.min(F.struct("doc_id", "h", "line")).alias("w"), F.count("*").alias("copies")))
    block = blocks(rows, line_units, frequent_arrays(counts), max(least, PAIRED), parity=True, few=MANY)
    order = first.select("k", "w")

    def later(pairs: DataFrame) -> DataFrame:
        """The later line of each pair that is linked."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        place = written(order.join(small(written(nodes)), "k"))
        links = verified(pairs, sets_of(rows, place.select("w.doc_id", "w.h", "w.line"), line_units))
        a, b = [place.select(F.col("k").alias(c), F.col("w").alias(f"w{c}")) for c in "ab"]
        return written(links.join(a, "a").join(b, "b").select(F.when(F.col("wa") > F.col("wb"), F.col("a")).otherwise(F.col("b")).alias("k")).distinct())

    pairs = block.where("k <> pivot").select(F.col("k").alias("a"), F.col("pivot").alias("b"), F.when(F.col("t").isNull(), F.col("n")).otherwise(0).alias("place"))
    pairs = written(pairs.groupBy("a", "b").agg(F.min("place").alias("place")))
    decided = later(written(pairs.where(F.col("place") < FIRST).select("a", "b")))
    # of the other pairs, those of which a line is still open
    gone = [small(decided.select(F.col("k").alias(c), F.lit(True).alias(f"g{c}"))) for c in "ab"]
    others = pairs.where(F.col("place") >= FIRST).join(gone[0], "a", "left").join(gone[1], "b", "left").where("ga is null or gb is null")
    decided = decided.unionByName(later(written(others.select("a", "b")))).distinct()
    # of blocks where a line had more pairs, lines that are not decided meet the others, tile by tile
    members = block.where("t is not null").select("t", "k", "n", "p", "s", "more").join(decided.withColumn("gone", F.lit(True)), "k", "left")
    for most in (TILE_FIRST, None):
        members = written(members)
        wide = members.groupBy("t").agg(F.count_if(F.col("more") & F.col("gone").isNull()).alias("open"), F.count("*").alias("m")).where("open > 0 and m > 1")
        wide = written(wide.select("t", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
        if wide.isEmpty():
            break
        members = members.join(small(wide), "t")
        now = later(written(tile_pairs(members, most).distinct()))
        decided = decided.unionByName(now).distinct()
        members = members.drop("tiles").join(now.withColumn("now", F.lit(True)), "k", "left").withColumn("gone", F.coalesce("gone", "now")).drop("now")
    near_copies = decided.withColumn("all", F.lit(True))
    fate = written(first.where("copies > 1").select("k", "w").join(near_copies, "k", "full"))
    out = lines.join(small(fate), "k").where(F.coalesce("all", F.lit(False)) | (F.struct("doc_id", "h", "line") > F.col("w")))
    return out.select("doc_id", "h", "line")


def drop_lines(docs: DataFrame, removed: str, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``docs`` with the column ``removed``: the ascending numbers of the lines that go; null where none goes."""
    gone = removed_lines(docs, id_col, text_col, least)
    d, h = f"{removed}_d", f"{removed}_h"
    lists = written(gone.distinct().groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.array_sort(F.collect_list("line")).alias(removed)))  # lines of one document
    there = F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(h))
    return docs.join(small(lists, removed), there, "left").drop(d, h)


def report(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined) and text_sha256 (of what is left) of every row."""
    lines = F.split("text", "\n", -1)
    return drop_lines(docs.select("doc_id", "text"), "gone", least=least).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.concat_ws(",", F.col("gone").cast("array<string>")), F.lit("")).alias("removed"),
        F.sha2(F.coalesce(kept_text("text", "gone"), F.lit("")), 256).alias("text_sha256"),
    )


def kept_text(text_col: str, removed: str):
    """The lines that stay; line numbers are looked up in order, so a document takes time in proportion to its lines."""
    kept = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.map_contains_key(F.map_from_arrays(removed, removed), i))
    return F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``docs`` without the removed lines; documents that lose all their lines go."""
    removed = f"removed_{uuid.uuid4().hex[:8]}"  # no column of the documents has this name
    marked = drop_lines(docs, removed, id_col, text_col, least)
    left = kept_text(text_col, removed)
    lost = F.col(removed).isNotNull() & (F.trim(F.regexp_replace(left, r"[\s]+", "")) == "")
    return marked.where(~lost).withColumn(text_col, left).select(*[F.col(f"`{c}`") for c in docs.columns])
