"""N-gram Jaccard join with signature trees (operator 2).

Documents are sets of distinct shingles of five words. Blocks of documents that share a token of their prefixes come from
``setjoin``; in a block that would be a leaf or few, its pairs are bounded directly there, in a larger one copies are linked to pivots. The rest of a larger block goes into a signature tree: leaves hold documents, nodes the OR of
their bitmaps, the range of their sizes and, where it is one, their component. Two nodes are walked together; a pair of nodes
is pruned when their components are the same, when their sizes are too far apart, or when the most that any two documents below
them may share is less than the least they must. Of all pairs, those that sizes and odd bits (as many bits as a set has tokens) leave open are
verified on their whole sets, which are made and moved for these alone.

Large blocks are cut into tiles of TILE documents, and pairs of tiles are walked in different tasks.

Null texts and texts without words have empty sets, are linked with nothing and are their own component. Texts of fewer than
five words are one shingle of all words. Equal sets are linked. Rows that share an id are one document if their texts are equal;
otherwise each text has its own row and links. A component's id is the least doc_id in it; null ids are never the least unless
all are null. Very long texts take memory in proportion to themselves. Further columns, of any names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, small, written
from .setjoin import PERCENT, PRIME_A, Sets, blocks, components, confirmed, distinct, frequent_arrays, mix, scan, sets_of, signatures, starts_of, word_hashes

SHINGLE = 5
BITS = 1024
TILE = 1_000
FAN = 8
#: Sets whose bits are counted at once; bytes of odd bits that are compared at once.
MARKED, COMPARED = 1_000, 16 << 20


def shingle_units(texts: list[str], length: int = SHINGLE):
    """A unit for each text: its shingles of ``length`` words."""
    h, sizes = word_hashes(texts)
    first = starts_of(sizes)
    n = np.where(sizes >= length, sizes - length + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(starts_of(n), n) + np.repeat(first, n)
    words = np.minimum(sizes, length)[owner]
    token = words.astype(np.uint64)
    for k in range(length):
        inside = k < words
        token = np.where(inside, mix(token * PRIME_A + h[np.where(inside, at + k, 0)]) if len(h) else token, token)
    owner, token = distinct(owner, token)
    return np.arange(len(texts)), np.zeros(len(texts), np.int64), owner, token


def bitmap(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS // 64, np.uint64)
    t = mix(tokens.view(np.uint64))
    np.bitwise_or.at(out, (t % np.uint64(BITS // 64)).astype(np.int64), np.uint64(1) << ((t >> np.uint64(20)) % np.uint64(64)))
    return out


def required(a, b):
    """The least overlap of sets of these sizes that are linked."""
    return (PERCENT * (a + b) + PERCENT + 99) // (100 + PERCENT)


class SignatureTree:
    """Over rows of size, bitmap and component; level 0 has the rows, each level above nodes of FAN."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, label: np.ndarray):
        order = np.lexsort((size, label))
        self.row = order
        extra = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # tokens beyond one for a bit
        self.levels = [(size[order], size[order], bits[order], extra[order], label[order], label[order])]
        while len(self.levels[-1][0]) > 1:
            low, high, b, e, first, last = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            # labels ascend, so a node's first and last tell whether it has one component
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(b, at), np.maximum.reduceat(e, at), first[at], last[np.minimum(at + FAN, len(low)) - 1]))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        at = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return at[at < len(self.levels[level - 1][0])]


def walk(left: SignatureTree, right: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two trees of equal height (or of one: same) that may be linked and are of different components."""

    def may_link(a, b, i, j) -> np.ndarray:
        apart = ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
        near = (100 * a[1][i] >= PERCENT * b[0][j]) & (100 * b[1][j] >= PERCENT * a[0][i])
        kept = np.flatnonzero(apart & near)
        i, j = i[kept], j[kept]
        most = np.bitwise_count(a[2][i] & b[2][j]).sum(axis=1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
        least = required(a[0][i], b[0][j])
        return kept[np.minimum(most, np.minimum(a[1][i], b[1][j])) >= least]

    top = max(len(left.levels), len(right.levels)) - 1
    pairs = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for level in range(top, -1, -1):
        a, b = left.levels[min(level, len(left.levels) - 1)], right.levels[min(level, len(right.levels) - 1)]
        following = []
        for i, j in pairs:
            if level < top:  # the children of both
                i = np.repeat(i, FAN) * FAN + np.tile(np.arange(FAN), len(i)) if level < len(left.levels) - 1 else np.repeat(i, FAN)
                j = np.repeat(j, FAN)
                once = np.ones(len(i), bool) if level < len(left.levels) - 1 else np.tile(np.arange(FAN) == 0, len(i) // FAN)
                i, j = i[once], j[once]
                if level < len(right.levels) - 1:
                    i, j = np.repeat(i, FAN), np.repeat(j, FAN) * FAN + np.tile(np.arange(FAN), len(j))
                inside = (i < len(a[0])) & (j < len(b[0]))
                if same:
                    inside &= i <= j
                i, j = i[inside], j[inside]
            for low in range(0, len(i), 200_000):  # bounded memory
                kept = may_link(a, b, i[low : low + 200_000], j[low : low + 200_000])
                if len(kept):
                    following.append((i[low : low + 200_000][kept], j[low : low + 200_000][kept]))
        pairs = following
    i = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    j = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
    if same:
        i, j = i[i != j], j[i != j]
    return left.row[i], right.row[j]


def tree_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows t, k, n, label, bits and odd that share t: those that the trees and then, in the same task, the odd bits leave open."""
    sizes = members.groupBy("t").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = members.join(written(sizes), "t").withColumn("c", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("*", other.alias("d")).select("t", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "k", "n", "label", "bits", "odd")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = rows.repartition(parts, "t", "i", "j").sortWithinPartitions("t", "i", "j")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def pairs_of(table: pa.Table, low: int, high: int):
            t = table.slice(low, high - low)
            c, k, n, label = [t.column(x).to_numpy() for x in ("c", "k", "n", "label")]
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(c), BITS // 64)
            odd = pa.concat_arrays(t.column("odd").chunks)
            i = t.column("i")[0].as_py() == c
            tree = SignatureTree(n[i].astype(np.int64), bits[i], label[i]) if i.any() else None
            if t.column("i")[0].as_py() == t.column("j")[0].as_py():
                return left_open(np.flatnonzero(i), np.flatnonzero(i), *walk(tree, tree, True), k, n, odd)
            if tree is None or i.all():
                return k[:0], k[:0]
            second = SignatureTree(n[~i].astype(np.int64), bits[~i], label[~i])
            return left_open(np.flatnonzero(i), np.flatnonzero(~i), *walk(tree, second, False), k, n, odd)

        def left_open(left, right, a, b, k, n, odd):
            a, b = left[a], right[b]
            kept = odd_open(n.astype(np.int64), odd, a, b)
            return k[a[kept]], k[b[kept]]

        def flush(rest: bool):
            table = pa.Table.from_batches(held)
            key = [table.column(x).to_numpy() for x in ("t", "i", "j")]
            edge = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in key], axis=0)))
            ends = np.append(edge[1:], len(table))
            found = [pairs_of(table, a, b) for a, b in zip(edge, ends, strict=True) if (rest or b < len(table)) and b - a > 1]
            tail = [] if rest else table.slice(int(edge[-1])).combine_chunks().to_batches()
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]), tail

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = flush(False)  # an open tile pair has 2 TILE rows or about so at most
                yield out
        if held:
            yield flush(True)[0]

    return dealt.mapInArrow(run, "a long, b long").distinct()


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Bytes cut at these ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def marks(s: Sets) -> list[pa.Array]:
    """The bitmap of each set; and of as many bits as it has tokens or more (a power of two, 64 at least) those on which an odd number of its tokens falls."""
    t, made = mix(s.token), [np.zeros((0, BITS // 8), np.uint8)]
    bit = (t % np.uint64(BITS // 64)) * np.uint64(64) + (t >> np.uint64(20)) % np.uint64(64)
    for low in range(0, len(s.size), MARKED):
        high = min(low + MARKED, len(s.size))
        at = slice(int(s.start[low]), int(s.start[high - 1] + s.size[high - 1]))
        there = np.zeros((high - low) * BITS, bool)
        there[(s.owner[at] - low) * BITS + bit[at].astype(np.int64)] = True
        made.append(np.packbits(there.reshape(-1, BITS), axis=1, bitorder="little"))
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(s.size, 64))).astype(np.int64))
    at = starts_of(width)[s.owner] + (t & (width[s.owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(bool), bitorder="little")
    return [binaries(np.arange(1, len(s.size) + 1) * (BITS // 8), np.concatenate(made)), binaries(np.cumsum(width) // 8, odd)]


def odd_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Odd bits in which sets differ, of the width of the narrower: a wider row is folded, its halves laid over each other."""
    a, b = (x.cast(pa.binary()) for x in (a, b))
    widths = np.stack([pa.compute.binary_length(x).to_numpy() for x in (a, b)], axis=1).astype(np.int64)
    out = np.zeros(len(a), np.int64)
    for pair in np.unique(widths, axis=0):
        at = np.flatnonzero((widths == pair).all(axis=1))
        x, y = [np.frombuffer(b"".join(z.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for z in (a, b)]
        while x.shape[1] != y.shape[1]:
            if x.shape[1] < y.shape[1]:
                x, y = y, x
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def odd_open(n: np.ndarray, odd: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and odd bits leave pairs of rows (i, j) open."""
    out = np.zeros(len(i), bool)
    step = max(1, COMPARED // max(1, odd.nbytes // max(1, len(odd))))  # bounded memory
    for low in range(0, len(i), step):
        x, y = i[low : low + step], j[low : low + step]
        most = (n[x] + n[y] - odd_apart(odd.take(pa.array(x)), odd.take(pa.array(y)))) // 2
        out[low : low + step] = most >= required(n[x], n[y])
    return out


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and odd bits leave open: two sets differ in at least as many tokens as odd bits. nodes: k, n, odd."""
    a, b = [nodes.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab"]
    near = (100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na"))
    both = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "na", "nb", "oa", "ob")

    def run(batches):
        forget()
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
                most = (n[0] + n[1] - odd_apart(batch.column(4), batch.column(5))) // 2
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(most >= required(*n)))

    return both.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles, component_id and component (a key of the component; null for empty sets) of every row."""
    rows = scan(docs, id_col, text_col)
    found, counts = signatures(rows, shingle_units, marks=marks, marked=("bits", "odd"))
    found = found.withColumnRenamed("n", "n_shingles")
    ones = [F.first(c).alias(x) for c, x in (("n_shingles", "n"), ("bits", "bits"), ("odd", "odd"))]  # equal for all rows of a node
    first = written(found.where("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("m"), F.min(F.struct("doc_id", "h", "line")).alias("w"), *ones))
    block = blocks(rows, shingle_units, frequent_arrays(counts))

    pairs = block.where("k <> pivot").select(F.col("k").alias("a"), F.col("pivot").alias("b"), F.when(F.col("t").isNull(), F.col("n")).otherwise(0).alias("place"))
    pairs = written(pairs.groupBy("a", "b").agg(F.min("place").alias("place")))

    def linked_of(chosen: DataFrame) -> DataFrame:
        """Whole sets are made and moved only for the pairs that their sizes and bits leave open."""
        left = written(may_link(chosen, first))
        nodes = left.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        place = first.select("k", "w").join(small(written(nodes)), "k")
        sets = sets_of(rows, place.select("w.doc_id", "w.h", "w.line"), shingle_units)
        out = written(confirmed(left, sets))
        release(sets)
        return out

    def known(labels: DataFrame) -> DataFrame:
        """Links that say as much as all that these labels came from."""
        return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))

    labels = components(linked_of(written(pairs.where("place = 0").select("a", "b"))))
    # of the other pairs, those that are not of one component yet
    ends = [small(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))) for c in "ab"]
    others = pairs.where("place > 0").join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(la, a) <> coalesce(lb, b)")
    others = linked_of(written(others.select("a", "b")))
    if not others.isEmpty():
        labels = components(known(labels).unionByName(others))
    # what is left: large blocks that still hold several components
    labelled = block.where("t is not null").select("t", "k", "n").join(labels.select(F.col("node").alias("k"), "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    labelled = written(labelled)
    several = written(labelled.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("t"))
    rest = written(labelled.join(small(several), "t", "left_semi"))
    if not rest.isEmpty():
        more = linked_of(written(tree_pairs(rest.join(first.select("k", "bits", "odd"), "k"))))
        if not more.isEmpty():
            labels = components(known(labels).unionByName(more))
    ends = labels.select(F.col("node").alias("k"), "label").unionByName(labels.select(F.col("label").alias("k"), "label")).distinct()  # a component's head has no label of its own
    placed = written(first.select("k", "m").join(small(written(ends)), "k").select("k", "m", "label"))
    heads = placed.groupBy("label").agg(F.min("m").alias("component_id"))
    linked = placed.join(heads, "label").select("k", "component_id", "label")
    alone = first.select("k", F.col("m").alias("own"))
    of = alone.join(small(written(linked)), "k", "left").select(F.col("k").alias("kk"), F.coalesce("component_id", "own").alias("component_id"), F.coalesce("label", "k").alias("component"))
    empty = F.when(F.col("n_shingles") > 0, F.col("k"))  # no key: never joined
    out = found.withColumn("kk", empty).join(of, "kk", "left")
    return out.select("doc_id", "h", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Callable = link) -> DataFrame:
    """``docs`` with one document of each component: that of the least id (null ids last), of equal ids that of the least hash of its text; of rows equal in both, one. Rows with empty sets all stay."""
    joined = written(link(docs, id_col, text_col).where("component is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "h")
    heads = joined.groupBy("component").agg(F.min(place).alias("head"))
    mark = uuid.uuid4().hex[:8]  # no column of the documents has these names
    d, h = f"d_{mark}", f"h_{mark}"
    names = [F.col("doc_id").alias(d), F.col("h").alias(h)]
    gone = written(joined.join(heads, "component").where(place != F.col("head")).select(*names).distinct())
    twice = written(joined.groupBy("doc_id", "h").count().where("count > 1").select(*names).distinct())
    there = F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(h))
    left = docs.join(small(gone), there, "left_anti")
    if twice.isEmpty():
        return left
    once, repeated = left.join(small(twice), there, "left_anti"), left.join(small(twice), there, "left_semi")
    return once.unionByName(repeated.dropDuplicates([id_col, text_col]))
