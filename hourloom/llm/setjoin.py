"""Exact Jaccard joins of token sets by prefixes: what the n-gram join (2) and the line join (10) share.

A unit (a document or a line) is a set of 64-bit token hashes; units with the same set are one node, named by a 64-bit hash of
the set. Tokens are ordered by rarity: those that the corpus-wide count finds frequent come last, by count, the others first,
by hash. Two sets of Jaccard similarity t or more share one of the first n - ceil(t n) + 1 tokens of each, so rows of a node
for each of these tokens (a block) meet all links. The order is the same everywhere, which is all that correctness needs.

A block that one task can hold is compared there: pairs that pass the length, positional and bitmap filters leave it, all of
them or for each node a few, as the join asks. Of a larger block, or one cut in parts, every node is first paired with the earliest (its pivot)
only, so groups of copies come together in linear work; its rows leave too, and each join has its own way with what is then still open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, small, text_runs, written

PERCENT = 80
#: Frequent tokens that tasks hold to order by: the most frequent ones, at most so many. Others count as rare.
MAX_FREQUENT = 400_000
#: Count from which a token is frequent; below, its block is small.
FREQUENT = 64
#: Rows for each part of the block of a frequent token, and most parts.
PART_ROWS, MAX_PARTS = 4_096, 32_767
#: Tokens counted together in a task, and the least count there that is sent on.
COUNT_RUN, COUNT_LEAST = 3_000_000, 4

#: Rows of a block that are compared side by side with other blocks, and rows that are held until a block is complete; larger ones go on as rows.
SMALL, HELD = 64, 4_096
#: Sizes and places in a packed row; larger ones are held to pass the filters.
FIELD = 24
MOST = (1 << FIELD) - 1

PRIME_A, PRIME_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= PRIME_B
    h ^= h >> np.uint64(29)
    return h


#: The low bytes of a lane of eight that belong to a word with so many left.
LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 256


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lowered), end to end; number of words of each. Words are hashed side by side, eight bytes at a time."""
    data = [t.encode("utf-8") for t in texts]
    first = np.cumsum([0, *[len(x) + 1 for x in data]])
    raw = b" ".join(data).lower() + b" " * 8
    byte = np.frombuffer(raw, np.uint8)
    gap = (byte - np.uint8(9) < 5) | (byte == 32)  # white space; differences wrap around
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge if gap[0] else np.append(0, edge)
    start, size = edge[::2], edge[1::2] - edge[::2]
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(((size.astype(np.uint64) * PRIME_B) ^ (lanes[start] & LANE[np.minimum(size, 8)])) * PRIME_A)  # most words end in the first lane
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        left = size[at] - done
        h[at] = mix((h[at] ^ (lanes[start[at] + done] & LANE[np.minimum(left, 8)])) * PRIME_A)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]])
    return h, np.diff(np.searchsorted(start, first))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))[:-1]


def distinct(owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's tokens once, ascending."""
    if not len(owner):
        return owner, token
    if owner[-1] < 1 << 24:  # owners ascend; one key sorts faster than two
        key = (owner.astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(24))
        order = np.argsort(key)
        key, t = key[order], token[order]
        if ((key[1:] == key[:-1]) & (t[1:] != t[:-1])).any():
            order = np.lexsort((token, owner))
    else:
        order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1]))
    return owner[new], token[new]


#: (texts) -> text number and line number of each unit, unit number and token of each member of a unit's set
Units = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


#: tokens ascending, ranks, parts
Frequent = tuple[np.ndarray, np.ndarray, np.ndarray]


class Sets:
    """The sets of a run of texts, ragged: sizes, nodes and tokens."""

    def __init__(self, units: Units, texts: list[str]):
        self.text, self.line, self.owner, self.token = units(texts)
        n = len(self.text)
        self.size = np.bincount(self.owner, minlength=n)
        self.start = starts_of(self.size)
        self.full = np.flatnonzero(self.size)
        total = np.zeros(n, np.uint64)
        if len(self.full):
            total[self.full] = np.add.reduceat(mix(self.token * PRIME_A), self.start[self.full])
        self.node = mix(total + self.size.astype(np.uint64) * PRIME_A).view(np.int64)

    def parities(self) -> np.ndarray:
        """For each set 64 bits: whether an odd number of its tokens falls on each. Two sets differ in at least as many tokens as bits."""
        out = np.zeros(len(self.size), np.uint64)
        if len(self.full):
            out[self.full] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(self.token) >> np.uint64(58)), self.start[self.full])
        return out

    def wide_parities(self) -> np.ndarray:
        """The same with 256 bits, in four columns."""
        bit, out = mix(self.token * PRIME_A) >> np.uint64(56), np.zeros((4, len(self.size)), np.uint64)
        if len(self.full):
            one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
            for w in range(4):
                out[w][self.full] = np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), self.start[self.full])
        return out

    def prefix(self, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """unit, token, place and number of parts of the token's block for the tokens of every unit's prefix."""
        keys, ranks, parts = frequent
        rank, cut = np.zeros(len(self.token), np.int64), np.ones(len(self.token), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, self.token), len(keys) - 1)
            there = keys[at] == self.token
            rank, cut = np.where(there, ranks[at], 0), np.where(there, parts[at], 1)
        place = np.arange(len(rank)) - self.start[self.owner]
        if not rank.any():
            order = np.arange(len(rank))
        elif len(self.size) < 1 << 20 and len(rank) < 1 << 24 and MAX_FREQUENT < 1 << 19:  # all in one key
            key = np.sort((self.owner << 43) | (rank << 24) | place)
            order = self.start[self.owner] + (key & ((1 << 24) - 1))
        else:
            order = np.lexsort((rank, self.owner))
        length = self.size - (PERCENT * self.size + 99) // 100 + 1
        kept = place < length[self.owner]
        order = order[kept]
        return self.owner[kept], self.token[order], place[kept], cut[order]


def may_match(n1, n2, p1, p2, s1=None, s2=None) -> np.ndarray:
    """Length, positional and bitmap filters: False where sets that first share tokens at these places cannot be linked."""
    most = np.minimum(n1 - p1, n2 - p2)
    total = n1 + n2
    if s1 is not None:
        most = np.minimum(most, (total - np.bitwise_count(s1 ^ s2)) // 2)
    near = (100 * n1 >= PERCENT * n2) & (100 * n2 >= PERCENT * n1) & (100 * most >= PERCENT * (total - most))
    return near | (np.maximum(n1, n2) == MOST)  # a size that did not fit


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text: with the id it names the row) and text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))


def counted_tokens(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur ``least`` times or more, ascending, and their counts. Empties ``held``, so that its tokens are in memory twice at most."""
    t = np.concatenate(held)
    held.clear()
    t.sort()
    start = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
    c = np.diff(np.append(start, len(t)))
    kept = c >= least
    return t[start[kept]], c[kept]


def signatures(rows: DataFrame, units: Units, least: int = 1, marks: Callable[[Sets], list[pa.Array]] | None = None, marked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, line, n, k of every unit; k is null for sets of fewer than ``least`` tokens), (t, c: frequent tokens and their counts).

    marks: gives binary columns of the names ``marked``, which come last.
    """
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        forget()
        held, size = [], 0

        def counted():
            t, c = counted_tokens(held, COUNT_LEAST)
            none = [pa.nulls(len(t), x.type) for x in example]
            return pa.RecordBatch.from_arrays([*none, pa.array(t.view(np.int64)), pa.array(c)], names=names)

        names = ["doc_id", "h", "line", "n", "k", *marked, "t", "c"]
        example = None
        for batch in batches:
            for low, texts in text_runs(batch.column(2)):
                s = Sets(units, texts)
                here = pa.array(s.text + low)
                cols = [batch.column(0).take(here), batch.column(1).take(here), pa.array(s.line.astype(np.int32)), pa.array(s.size.astype(np.int32)), pa.array(s.node, mask=s.size < least), *(marks(s) if marks else [])]
                example = cols
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(s.text), pa.int64())] * 2], names=names)
                held.append(s.token)
                size += len(s.token)
                if size > COUNT_RUN:
                    yield counted()
                    size = 0
        if size:
            yield counted()

    both = written(rows.mapInArrow(run, f"doc_id {doc_type}, h long, line int, n int, k long, {''.join(f'{m} binary, ' for m in marked)}t long, c long"))
    return both.where("t is null").drop("t", "c"), both.where("t is not null").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)


def frequent_arrays(counts: DataFrame, limit: int = MAX_FREQUENT) -> Frequent:
    """The most frequent tokens ascending, their ranks from 1 (the rarest of them) and the parts of their blocks."""
    top = counts.orderBy(F.desc("c"), "t").limit(limit).toArrow()  # limit rows at most
    t, c = [top.column(x).to_numpy() for x in ("t", "c")]
    up = np.lexsort((t, c))
    keys = t[up].view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (np.arange(len(keys)) + 1)[order], np.minimum(-(-c[up] // PART_ROWS), MAX_PARTS)[order]


def best_of(i: np.ndarray, j: np.ndarray, apart: np.ndarray, few: int) -> np.ndarray:
    """Place of each pair among those of its i, the least apart first, then the first j; ``few`` for all beyond."""
    out = np.full(len(i), few)
    if len(i):
        order = np.lexsort((j, apart, i))
        start = np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1]))
        size = np.diff(np.append(start, len(i)))
        out[order] = np.minimum(np.arange(len(i)) - np.repeat(start, size), few)
    return out


def blocks(rows: DataFrame, units: Units, frequent: Frequent, least: int = 1, parity: bool = False, few: int | None = None) -> DataFrame:
    """Pairs of nodes that may be linked (k and pivot, with null for t), and rows t, k, n, p, s, pivot, more of blocks that have more to compare.

    A row's pivot is the earliest node of its block or part; the node itself where the filters exclude a link.
    few: of a block only so many pairs of each node with earlier ones come, n tells their place; where nodes have more, the rows of the block come and ``more`` marks those nodes.
    Otherwise all pairs of blocks of SMALL rows or fewer come (n is 0 for those with the block's first), and of others the rows. parity: with the bitmap filter.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(frequent)  # MAX_FREQUENT tokens at most
    made = ["t", "o", "k", "m"] + ["s"] * parity

    def emit(batches):
        forget()
        seen: set[int] = set()
        for batch in batches:
            order = pa.compute.fill_null(pa.compute.cast(batch.column(0), pa.int64(), safe=False) if not pa.types.is_string(batch.column(0).type) else batch.column(1), -(1 << 63))
            for low, texts in text_runs(batch.column(2)):
                s = Sets(units, texts)
                fresh = np.zeros(len(s.node), bool)
                for i, k in enumerate(s.node.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = s.size[i] >= least
                if len(seen) > 500_000:
                    seen.clear()
                unit, token, place, parts = s.prefix(sent.value)
                kept = fresh[unit]
                unit, token, place, parts = unit[kept], token[kept], place[kept], parts[kept]
                o = order.slice(low, len(texts)).to_numpy(zero_copy_only=False)[s.text[unit]]
                part = np.where(parts > 1, 1 + s.node[unit] % np.maximum(parts, 1), 0)
                packed = (part << (2 * FIELD)) | (np.minimum(s.size[unit], MOST) << FIELD) | np.minimum(place, MOST)
                cols = [token.view(np.int64), o.astype(np.int64), s.node[unit], packed]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, *([s.parities()[unit].view(np.int64)] if parity else []))], names=made)

    def of(t: np.ndarray | None, cols: list[np.ndarray], pivot: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
        k, n, p, s = [pa.array(x) for x in cols]
        n, p, more = n.cast(pa.int32()), p.cast(pa.int32()), pa.array(np.full(len(k), t is not None) if more is None else more)
        return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()) if t is None else pa.array(t), k, n, p, s, pa.array(pivot), more], names=["t", "k", "n", "p", "s", "pivot", "more"])

    def match(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The filters, on columns k, n, p, s."""
        bits = [x[3].astype(np.int64).view(np.uint64) for x in (a, b)] if parity else []
        return may_match(a[1], b[1], a[2], b[2], *bits)

    def inner(cols: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (later, earlier) of rows of these blocks that pass the filters, of SMALL rows or fewer each."""
        rows = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place, far, i, j = np.zeros(len(cols[0]), np.int64), rows, [], []
        place[rows] = rows - np.repeat(start, size)
        for d in range(1, int(size.max()) if len(size) else 0):  # rows d apart
            far = far[place[far] >= d]
            hit = match([c[far] for c in cols], [c[far - d] for c in cols]) & (cols[0][far] != cols[0][far - d])
            i.append(far[hit])
            j.append(far[hit] - d)
        return (np.concatenate(i), np.concatenate(j)) if i else (rows[:0], rows[:0])

    def wide(cols: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one larger block: each row meets those of sizes that fit."""
        by_size = low + np.argsort(cols[1][low:high], kind="stable")
        n, i, j = cols[1][by_size], [], []
        for a in range(0, high - low, 256):
            x = by_size[a : a + 256]
            b = int(np.searchsorted(n, -(-PERCENT * n[a] // 100))) if n[min(a + 256, len(n)) - 1] < MOST else 0
            y = by_size[b : min(a + 256, len(n))]  # of equal size or smaller
            hit = match([c[x][:, None] for c in cols], [c[y] for c in cols]) & (cols[0][x][:, None] != cols[0][y]) & (np.arange(a, a + len(x))[:, None] > np.arange(b, b + len(y)))
            u, v = np.nonzero(hit)
            i.append(np.maximum(x[u], y[v]))
            j.append(np.minimum(x[u], y[v]))
        return np.concatenate(i), np.concatenate(j)

    def whole(t: np.ndarray, cols: list[np.ndarray]):
        """Complete blocks."""
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(start, len(t)))
        little = (size > 1) & (size <= SMALL)
        i, j = inner(cols, start[little], size[little])
        large = np.flatnonzero(size > SMALL)
        if few is None:
            place = (start[np.searchsorted(start, i, "right") - 1] < j).astype(np.int64)  # 0: with the block's first
            rows = np.repeat(start[large], size[large])
            rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(size[large]) - size[large], size[large])
            first = np.repeat(start[large], size[large])
        else:
            more = [wide(cols, start[b], start[b] + size[b]) for b in large.tolist()]
            i, j = np.concatenate([i, *[x for x, _ in more]]), np.concatenate([j, *[x for _, x in more]])
            apart = np.bitwise_count((cols[3][i] ^ cols[3][j]).view(np.uint64)).astype(np.int64)
            place = best_of(i, j, apart, few)
            beyond = np.zeros(len(t), bool)
            beyond[i[place == few]] = beyond[j[place == few]] = True  # either end may be the line that is still open
            still = np.unique(np.searchsorted(start, np.flatnonzero(beyond), "right") - 1)  # blocks with more pairs
            i, j, place = i[place < few], j[place < few], place[place < few]
            rows = np.repeat(start[still], size[still])
            rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(size[still]) - size[still], size[still])
            first = rows  # their pairs are out: no pivot
        if len(i):
            a, b = np.maximum(cols[0][i], cols[0][j]), np.minimum(cols[0][i], cols[0][j])
            order = np.lexsort((place, b, a))
            a, b, place = a[order], b[order], place[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            none = np.zeros(int(new.sum()), np.int64)
            yield of(None, [a[new], place[new], none, none], b[new])
        if len(rows):
            mine, head = [c[rows] for c in cols], [c[first] for c in cols]
            yield of(t[rows], mine, np.where(match(mine, head), head[0], mine[0]), None if few is None else beyond[rows])

    def wider(batches):
        """Columns of several batches at once: work side by side pays for long arrays."""
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(made))])
            size += batch.num_rows
            if size >= 1 << 16:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
        if size:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def gather(batches):
        forget()
        last = head = None  # the open part of a block in parts: token and part, first row
        carry: list[np.ndarray] | None = None  # rows of the open block in one part
        huge = None  # its token and first row, if its rows are no longer held
        for got in wider(batches):
            t, k, m = got[0], got[2], got[3]
            part = m >> (2 * FIELD)
            cols = [k, (m >> FIELD) & MOST, m & MOST, got[4] if parity else np.zeros(len(k), np.int64)]
            cut = part > 0
            if cut.any():
                bt, bp, bc = t[cut], part[cut], [x[cut] for x in cols]
                new = np.append(last != (int(bt[0]), int(bp[0])), (bt[1:] != bt[:-1]) | (bp[1:] != bp[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(len(bt)), -1))
                piv = [np.where(first >= 0, x[first], y) for x, y in zip(bc, head or [0] * 4, strict=True)]
                yield of(bt, bc, np.where(match(bc, piv), piv[0], bc[0]))
                last, head = (int(bt[-1]), int(bp[-1])), [int(x[-1]) for x in piv]
            if not cut.all():
                one = [x[~cut] for x in (t, *cols)]
                if huge is not None:
                    n = int((one[0] == huge[0]).sum())  # they come first
                    more = [x[:n] for x in one[1:]]
                    yield of(one[0][:n], more, np.where(match(more, huge[1]), huge[1][0], more[0]))
                    one = [x[n:] for x in one]
                    if not len(one[0]):
                        continue
                    huge = None
                if carry is not None:
                    one = [np.concatenate([a, b]) for a, b in zip(carry, one, strict=True)]
                n = int(np.flatnonzero(np.append(True, one[0][1:] != one[0][:-1]))[-1])
                if n:
                    yield from whole(one[0][:n], [x[:n] for x in one[1:]])
                carry = [x[n:] for x in one]
                if len(carry[0]) > HELD:
                    head_row = [x[:1] for x in carry[1:]]
                    yield of(carry[0], carry[1:], np.where(match(carry[1:], head_row), head_row[0], carry[1]))
                    huge, carry = (int(carry[0][0]), head_row), None
        if carry is not None:
            yield from whole(carry[0], carry[1:])

    emitted = rows.mapInArrow(emit, ", ".join(f"{c} long" for c in made))
    part = F.shiftright("m", 2 * FIELD)
    dealt = emitted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, "t", part).sortWithinPartitions("t", part, "o", "k")
    return written(dealt.mapInArrow(gather, "t long, k long, n int, p int, s long, pivot long, more boolean"))


def sets_of(rows: DataFrame, place: DataFrame, units: Units) -> DataFrame:
    """k, tokens and parities (q0 to q3) of nodes, made anew from the rows at ``place`` (doc_id, h, line: one for each node)."""
    lines = written(place.groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines")))  # lines of one row
    there = F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.h") == F.col("l.h"))
    chosen = rows.alias("r").join(small(lines, "lines").alias("l"), there).select("l.lines", "r.text")

    def run(batches):
        forget()
        for batch in batches:
            for low, texts in text_runs(batch.column(1)):
                s = Sets(units, texts)
                wanted = [set(x) for x in batch.column(0).slice(low, len(texts)).to_pylist()]
                hit = np.flatnonzero(np.fromiter((line in wanted[t] for t, line in zip(s.text.tolist(), s.line.tolist(), strict=True)), bool, len(s.text)))
                ends = np.cumsum(s.size[hit])
                index = np.repeat(s.start[hit] - (ends - s.size[hit]), s.size[hit]) + np.arange(int(ends[-1]) if len(ends) else 0)
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(s.token[index].view(np.int64)))
                odd = [pa.array(q[hit].view(np.int64)) for q in s.wide_parities()]
                yield pa.RecordBatch.from_arrays([pa.array(s.node[hit]), tokens, *odd], names=["k", "tokens", "q0", "q1", "q2", "q3"])

    made = chosen.mapInArrow(run, "k long, tokens array<long>, q0 long, q1 long, q2 long, q3 long")
    return written(made.dropDuplicates(["k"]))


def linked(same: Column, n: Column) -> Column:
    """Whether sets that have ``n`` tokens together and share ``same`` have a Jaccard similarity of PERCENT or more."""
    return 100 * same >= PERCENT * (n - same)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of PERCENT or more. Whole sets move only for pairs that their sizes and parities leave open."""
    qs = [f"q{w}" for w in range(4)]
    sizes = small(sets.select("k", F.size("tokens").alias("n"), *qs))
    a, b = [sizes.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), *[F.col(q).alias(f"{q}{c}") for q in qs]) for c in "ab"]
    both = pairs.join(a, "a").join(b, "b")
    n = F.col("na") + F.col("nb")
    apart = sum((F.bit_count(F.col(f"{q}a").bitwiseXOR(F.col(f"{q}b"))) for q in qs[1:]), F.bit_count(F.col("q0a").bitwiseXOR(F.col("q0b"))))
    return confirmed(written(both.where(linked(F.least(F.floor((n - apart) / 2), F.col("na"), F.col("nb")), n)).select("a", "b")), sets)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of PERCENT or more; the sets of all of them move."""
    a, b = [sets.select(F.col("k").alias(c), F.col("tokens").alias(f"s{c}")) for c in "ab"]
    both = pairs.join(a, "a").join(b, "b")
    return both.where(linked(F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node that links lead to) of all nodes that have links, by alternating large and small stars until only stars are left."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # done when each node has one way to a smaller one, and that has none
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or out = 1 and into > 0").isEmpty():
            break
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
