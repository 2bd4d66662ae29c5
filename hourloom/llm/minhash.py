"""MinHash near-duplicates with bottom-k sketches (operator 12).

Documents are sets of distinct shingles of three words; documents of one set are one node, named by 128 bits. A shingle's 64-bit hash is the one hash
function: a node's sketch is its KEPT smallest hashes. Of two sets of similarity 0.85, each of the smallest hashes of their union
is in both with odds of 0.85, so at least AGREE of the LISTED smallest, and LEAST_SHARED of the KEPT smallest, are but for odds of about 1e-10; sets that
sketches hold whole are compared exactly. Hence

* inverted lists: a node stands in the lists of all but AGREE - 1 of its LISTED smallest hashes, the most frequent of all documents being left out, so
  nodes that are linked meet in a list, and a passage that many documents share makes no long one;
* estimates: of pairs that meet, those stay that share LEAST_SHARED of the KEPT smallest of both sketches;
* proof: every link is confirmed on whole sets, made anew from the texts.

Nodes of a list first meet its earliest only, then those outside its largest component meet one of that; so copies come together in linear work. Then short lists
(LONG nodes or fewer) compare what is of different components yet. Long ones get the whole sets: nodes outside the largest component meet all others, tile by tile, and one
link to each component is sent, never all pairs.

Null texts and texts without words have empty sets, are linked with nothing and are their own component. Texts of fewer than three words are one shingle of all words. Rows that share an
id and a text are one document; if the texts differ, each has its own row and links. A component's id is the least doc_id in it; null ids are the least
of none. Very long texts take memory in proportion to themselves. An empty table gives an empty result. Further columns, of any names, are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, small, text_runs, written
from .ngram_join import keep_one as keep_one_by
from .ngram_join import shingle_units
from .setjoin import FREQUENT, PRIME_A, PRIME_B, Sets, components, frequent_arrays, mix, scan, starts_of

SHINGLE, PERCENT = 3, 85
#: Hashes of a sketch and how many of the union's smallest two sketches must share; the same for hashes with inverted lists.
KEPT, LEAST_SHARED = 64, 32
LISTED, AGREE = 32, 12
#: Nodes of a list that are compared pair by pair through their sketches; longer lists get the whole sets.
LONG = 64
#: Shingles that a tile of a long list holds, and matches of shingles that are counted at once.
TILE_TOKENS, MATCHES = 500_000, 4_000_000
#: Characters of pairs of texts that are compared at once.
PAIR_CHARS = 2_000_000

PAD = np.uint64(0xFFFFFFFFFFFFFFFF)
units = functools.partial(shingle_units, length=SHINGLE)


def fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes may be linked."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def enough(same, n):
    """Whether sets of ``n`` members together that share ``same`` are linked."""
    return 100 * same >= PERCENT * (n - same)


def sketched(rows: DataFrame) -> DataFrame:
    """doc_id, h, n, k (name of the set; null for empty ones) and sketch (where the task meets the set first) of every row."""

    def run(batches):
        forget()
        seen: set[bytes] = set()
        for batch in batches:
            for low, texts in text_runs(batch.column(2)):
                s = Sets(units, texts)
                second = np.zeros(len(texts), np.uint64)
                if len(s.full):
                    second[s.full] = np.add.reduceat(mix(mix(s.token ^ PRIME_B) + PRIME_A), s.start[s.full])
                names = [x.tobytes() for x in np.stack([s.node.view(np.uint64), second], axis=1)]
                sketches: list[bytes | None] = []
                for name, at, n in zip(names, s.start.tolist(), s.size.tolist(), strict=True):
                    sketches.append(s.token[at : at + min(n, KEPT)].tobytes() if n and name not in seen else None)
                    if n:
                        seen.add(name)
                if len(seen) > 300_000:
                    seen.clear()
                cols = [batch.column(0).slice(low, len(texts)), batch.column(1).slice(low, len(texts)), pa.array(s.size.astype(np.int32))]
                names_or_null = [x if n else None for x, n in zip(names, s.size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names_or_null, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "n", "k", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, n int, k binary, sketch binary")


def hashes(sketches: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the sketch, hash) of the ``most`` smallest hashes of each, ascending."""
    held = [x[: 8 * most] for x in sketches.to_pylist()]
    return np.repeat(np.arange(len(held)), [len(x) // 8 for x in held]), np.frombuffer(b"".join(held), np.uint64)


def in_lists(nodes: DataFrame) -> DataFrame:
    """t, i and n: the lists that each node stands in."""

    def values(batches):
        forget()
        for batch in batches:
            t, c = np.unique(hashes(batch.column(0), LISTED)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], names=["t", "c"])

    counts = nodes.select("sketch").mapInArrow(values, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    sent = nodes.sparkSession.sparkContext.broadcast(frequent_arrays(counts))  # a bounded number of the most frequent; the others count as rare

    def run(batches):
        forget()
        keys, ranks, _ = sent.value
        for batch in batches:
            owner, value = hashes(batch.column(2), LISTED)
            rank = np.zeros(len(value), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                rank = np.where(keys[at] == value, ranks[at], 0)
            order = np.lexsort((rank, owner))  # stable: by hash among equals
            size = np.bincount(owner, minlength=batch.num_rows)
            n = batch.column(1).to_numpy()
            shared = np.where(PERCENT * LISTED >= 100 * n, -(-PERCENT * n // 100), AGREE)  # sets so small that the union is listed: exact
            kept = np.arange(len(owner)) - starts_of(size)[owner] < (size - shared + 1)[owner]
            who = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays([pa.array(value[order][kept].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who)], names=["t", "i", "n"])

    return written(nodes.select("i", "n", "sketch").mapInArrow(run, "t long, i long, n int"))


def matrix(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out = np.full((rows, KEPT), PAD)
    out[owner, np.arange(len(owner)) - starts_of(np.bincount(owner, minlength=rows))[owner]] = value
    return out


def shared_of_union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of the KEPT smallest hashes of both sketches, how many are in both; how many all told), row by row."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    place = np.cumsum(~again, axis=1) + 1  # of the distinct hash
    again &= both[:, 1:] != PAD
    return (again & (place <= KEPT)).sum(axis=1), again.sum(axis=1)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and sure (proved, as both sketches hold all): the pairs (a, b) that sketches leave open or prove."""
    a, b = [nodes.select(F.col("i").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]

    def run(batches):
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
            some, every = shared_of_union(*[matrix(*hashes(batch.column(c), KEPT), batch.num_rows) for c in (3, 5)])
            whole = (na <= KEPT) & (nb <= KEPT)
            stay = pa.array(np.flatnonzero(np.where(whole, enough(every, na + nb), some >= LEAST_SHARED)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(stay), batch.column(1).take(stay), pa.array(whole).take(stay)], names=["a", "b", "sure"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb")
    return written(joined.mapInArrow(run, "a long, b long, sure boolean"))


def texts_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """i and text of the nodes ``wanted`` (i, distinct): one row's text for each."""
    place = written(nodes.join(small(written(wanted)), "i").select("i", F.col("place.doc_id").alias("d"), F.col("place.h").alias("ph")))
    there = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("ph"))
    texts = written(rows.join(small(place), there).select("i", "text"))
    return texts if texts.select("i").count() == place.count() else texts.dropDuplicates(["i"])  # rows that come twice


def proved(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    texts = texts_of(rows, nodes, pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct())

    def run(batches):
        forget()
        for batch in batches:
            size = np.add(*[pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy() for c in (2, 3)])
            run_of = np.cumsum(size) // PAIR_CHARS
            for low, high in zip(*[f(run_of, np.unique(run_of), x) for f, x in ((np.searchsorted, "left"), (np.searchsorted, "right"))], strict=True):
                a, b = [Sets(units, batch.column(c).slice(low, high - low).to_pylist()) for c in (2, 3)]
                owner, token = np.concatenate([a.owner, b.owner]), np.concatenate([a.token, b.token])
                order = np.lexsort((token, owner))
                owner, token = owner[order], token[order]
                same = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (token[1:] == token[:-1])], minlength=high - low)
                hit = pa.array(low + np.flatnonzero(enough(same, a.size + b.size)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit)], names=["a", "b"])

    a, b = [texts.select(F.col("i").alias(x), F.col("text").alias(f"t{x}")) for x in "ab"]
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links among pairs (a, b)."""
    found = estimated(pairs.distinct(), nodes)
    open_pairs = found.where("not sure").select("a", "b")
    links = found.where("sure").select("a", "b")
    return links if open_pairs.isEmpty() else links.unionByName(proved(open_pairs, rows, nodes))


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components in the same list: of each node outside a list's largest component, one to each component that it reaches.

    members: t, i, n, label, outside, tiles; sets: i, tokens.
    """
    base = members.withColumn("side", F.lit(0)).withColumn("tile", F.pmod(F.xxhash64("i"), F.col("tiles")).cast("int"))
    probes = members.where("outside").withColumn("side", F.lit(1)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    cols = ["t", "tile", "side", "i", "label"]
    dealt = base.select(*cols).unionByName(probes.select(*cols)).join(sets, "i").select(*cols, "tokens").repartition(parts, "t", "tile").sortWithinPartitions("t", "tile", "side", "i")

    class Tile:
        def __init__(self):
            self.i, self.label, self.sets = [], [], []
            self.ready = False

        def add(self, i: int, label: int, tokens: np.ndarray) -> None:
            self.i.append(i)
            self.label.append(label)
            self.sets.append(tokens)

        def close(self) -> None:
            if not self.ready:
                token, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
                order = np.argsort(token, kind="stable")
                self.token, self.owner = token[order], owner[order]
                self.size = np.array([len(x) for x in self.sets])
                self.i, self.label, self.ready = np.array(self.i), np.array(self.label), True

        def reached(self, i: int, label: int, tokens: np.ndarray) -> np.ndarray:
            """One node of each other component that this one is linked with."""
            low, high = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
            same, ends = np.zeros(len(self.i), np.int64), np.cumsum(high - low)
            at = 0
            while at < len(tokens):  # MATCHES at once, or one shingle's
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MATCHES, "right")))
                n = (high - low)[at:to]
                where = np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                same += np.bincount(self.owner[where], minlength=len(same))
                at = to
            hit = np.flatnonzero((self.label != label) & enough(same, self.size + len(tokens)))
            return self.i[hit[np.unique(self.label[hit], return_index=True)[1]]]

    def run(batches):
        forget()
        tile, key = None, None
        for batch in batches:
            t, g, side, i, label = [batch.column(c).to_pylist() for c in range(5)]
            a, b = [], []
            for at in range(batch.num_rows):
                if key != (t[at], g[at]):
                    tile, key = Tile(), (t[at], g[at])
                tokens = np.frombuffer(batch.column(5)[at].as_py(), np.uint64)
                if side[at] == 0:
                    tile.add(i[at], label[at], tokens)
                elif tile.sets:
                    tile.close()
                    others = tile.reached(i[at], label[at], tokens).tolist()
                    a += [i[at]] * len(others)
                    b += others
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(dealt.mapInArrow(run, "a long, b long"))


def whole_sets(texts: DataFrame) -> DataFrame:
    """i and tokens (hashes ascending, eight bytes each)."""

    def run(batches):
        forget()
        for batch in batches:
            for low, run_texts in text_runs(batch.column(1)):
                s = Sets(units, run_texts)
                sets = [s.token[at : at + n].tobytes() for at, n in zip(s.start.tolist(), s.size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(run_texts)), pa.array(sets, pa.binary())], names=["i", "tokens"])

    return written(texts.mapInArrow(run, "i long, tokens binary"))


def joined_up(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and label of all nodes with links, after ``links`` more: a label becomes the least of those that it is linked with, and that one's own. Nodes of one label are linked; not all that are linked need have one label yet."""
    ends = links
    if labels is not None:
        la, lb = [labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"]
        ends = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    ways = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    further = least.select(F.col("a").alias("m"), F.col("m").alias("beyond"))
    moved = least.join(further, "m").select(F.col("a").alias("node"), F.col("beyond").alias("label"))
    if labels is None:
        return written(moved)
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    kept = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(kept.unionByName(moved.join(labels.select("node"), "node", "left_anti")))


def node_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and label (the least node that links lead to) of all nodes that have links."""
    lists = in_lists(nodes)
    heads = written(lists.groupBy("t").agg(F.count("*").alias("c"), F.min("i").alias("head"), F.min_by("n", "i").alias("nh")).where("c > 1"))
    met = written(lists.join(small(heads), "t"))
    links = linked(met.where((F.col("i") != F.col("head")) & fits(F.col("n"), F.col("nh"))).select(F.col("i").alias("a"), F.col("head").alias("b")), rows, nodes)
    labels = joined_up(None, links)

    def mixed(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their labels; lists of several: their largest one, and a node of it, drawn for each list."""
        members = met.join(labels.select(F.col("node").alias("i"), "label"), "i", "left").select("t", "i", "n", "c", F.coalesce("label", "i").alias("label"))
        members, drawn = written(members), F.xxhash64("t", "i")
        of = members.groupBy("t", "label").agg(F.count("*").alias("m"), F.min_by("i", drawn).alias("one"), F.min_by("n", drawn).alias("n_one"), F.sum("n").alias("tokens"))
        of = of.groupBy("t").agg(F.count("*").alias("several"), F.max(F.struct("m", "label", "one", "n_one")).alias("most"), F.sum("tokens").alias("tokens"))
        return members, written(of.where("several > 1").select("t", F.col("most.label").alias("largest"), F.col("most.one").alias("one"), F.col("most.n_one").alias("n_one"), "tokens"))

    members, several = mixed(labels)
    pairs = members.join(small(several), "t").where((F.col("label") != F.col("largest")) & fits(F.col("n"), F.col("n_one")))
    found = linked(pairs.select(F.col("i").alias("a"), F.col("one").alias("b")), rows, nodes)
    links, labels = links.unionByName(found), joined_up(labels, found)
    members, several = mixed(labels)
    members = written(members.join(small(several), "t"))
    short = members.where(F.col("c") <= LONG).select("t", "i", "n", "label")
    a, b = [short.toDF("t", x, f"n{x}", f"l{x}") for x in "ab"]
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits(F.col("na"), F.col("nb")))
    links = links.unionByName(linked(pairs.select("a", "b"), rows, nodes))
    long = members.where(F.col("c") > LONG)
    if not long.isEmpty():
        long = long.select("t", "i", "n", "label", (F.col("label") != F.col("largest")).alias("outside"), F.ceil(F.col("tokens") / TILE_TOKENS).cast("int").alias("tiles"))
        links = links.unionByName(tile_links(long, whole_sets(texts_of(rows, nodes, long.select("i").distinct()))))
    return components(links)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles, component_id and component (a key of the component; null for empty sets) of every row."""
    rows = scan(docs, id_col, text_col)
    found = written(sketched(rows))
    of = found.where("n > 0").groupBy("k").agg(F.max("n").alias("n"), F.min("doc_id").alias("m"), F.min(F.struct("doc_id", "h")).alias("place"), F.max("sketch").alias("sketch"))
    nodes = written(of.withColumn("i", F.monotonically_increasing_id()))  # written once: the numbers stay
    labels = node_links(rows, nodes)
    placed = written(nodes.select("k", "i", "m").join(labels.select(F.col("node").alias("i"), "label"), "i", "left").select("k", "m", F.coalesce("label", "i").alias("component")))
    heads = placed.groupBy("component").agg(F.min("m").alias("component_id"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    own = written(placed.join(small(written(heads)), "component", "left").select("k", "component", F.when(F.col("component_id").isNull(), F.col("m")).otherwise(F.col("component_id")).alias("component_id")))
    out = found.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "k").join(own, "k", "left")
    alone = F.col("component").isNull()
    return out.select("doc_id", "h", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the least id of its component; null where that is null) of every row."""
    return link(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, as ``ngram_join.keep_one`` chooses it."""
    return keep_one_by(docs, id_col, text_col, link)
