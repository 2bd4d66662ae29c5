"""Language-model scoring with causal self-attention (operator 1).

A text is the subword ids of its lower-cased words, each after a space, and an end id. The model gives an id the probability of its class times its
share of the class. Frequent ids are classes of their own, the others are grouped by what stands before them. Classes are predicted by the sum of
two parts: logarithms of how often the class follows the last id, counted over all training documents, and one head of causal self-attention
over the ids before, with a learned weight for each distance. An id's share of its class is counted by what stands before it too. Texts are scored in windows of
LENGTH ids that overlap; a window scores the ids that the window before has not, so each id is scored once, all windows of a run in masked batches.

What is learned: counts of words and of pairs of ids over all training documents, and the attention by stochastic gradient steps on every id of every
training document, once. For that the documents are dealt by hash of id and text into shards of about SHARD_IDS ids, whose number follows from the counts, so a shard has the same
rows in the same order however the table is partitioned. The first shard trains a common start; each other shard trains a copy of it, and the copies are
averaged in whole numbers, so in any order alike. What is gathered grows with the corpus; only sums over the vocabulary (bounded), parameters and the
MAX_COMMON most frequent words (bounded) are sent to workers. Counts of all other words are joined.

Null is as ''. A text without words has the end token alone. Very long texts take memory in proportion to themselves. Null ids are training documents. Repeated rows count
each time and are scored alike. Ties among frequent ids and words go to the smaller one. Other columns are not read. Without training documents all counts are 0 and the model is uniform over ids. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, remainder, text_runs, worker_state, written
from .setjoin import word_hashes

LENGTH, STRIDE = 64, 56
WIDTH, OWN_CLASSES, GROUPS, KINDS = 16, 128, 32, 1_024
BUCKETS = 64  # of what stands before an id: the most frequent ids, and all others
CLASSES, INPUTS = OWN_CLASSES + GROUPS, KINDS + GROUPS
SHARD_IDS, BATCH, RATE, WARM_UP = 2_000_000, 32, 0.01, 50
#: Windows scored at once, and windows that go through the model side by side: few enough that their logits stay in the processor's cache.
SCORED_AT_ONCE, SIDE_BY_SIDE = 32, 8
#: Words whose counts every worker holds.
MAX_COMMON = 200_000
#: Added to the count of an id, of an id's share and of a class after an id: an id, its share of the class, the class's share.
SMOOTH, SHARE_SMOOTH, CLASS_SMOOTH = 0.5, 4.0, 2.0
#: Different keys that a task holds before it sends its counts on.
HELD_KEYS = 1_500_000


class Subwords:
    """ids of texts."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.stored = "<u2" if self.size <= 1 << 16 else "<u4"

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8").lower().split()
        ids = self.encode(" " + b" ".join(words).decode("utf-8")) if words else []
        return np.array([*ids, self.end], self.stored)


class Sums:
    """Counts of 64-bit keys, kept in arrays."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > HELD_KEYS:
            self.held = [self.total()]
            self.size = len(self.held[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in self.held]), len(keys)).astype(np.int64)


def encoded(rows: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """(id, held_out, text and ids of every row), (kind, key, c of the training rows: words by hash (0), pairs of ids (1), documents (2)); each text is encoded once, each task adds up first."""
    id_type = rows.schema["id"].dataType

    def run(batches):
        forget("subwords")
        subwords = worker_state(("subwords", *make), lambda: Subwords(*make))
        words, pairs, docs = Sums(), Sums(), 0
        names = ["id", "held_out", "text", "ids", "kind", "key", "c"]

        def sent(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.nulls(n, arrow_id), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(np.full(n, kind, np.int32)), pa.array(keys), pa.array(counts)], names=names)

        arrow_id = None
        for batch in batches:
            arrow_id = batch.column(0).type
            for low, texts in text_runs(batch.column(2)):
                there, n = [batch.column(i).slice(low, len(texts)) for i in (0, 1)], len(texts)
                ids = [subwords(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*there, pa.array(texts, pa.string()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                training = [k for k, out in enumerate(there[1].to_pylist()) if not out]
                if training:
                    docs += len(training)
                    words.add(word_hashes([texts[k] for k in training])[0].view(np.int64))
                    end = np.array([subwords.end], subwords.stored)
                    flat = np.concatenate([end, *[ids[k] for k in training]]).astype(np.int64)  # each text ends with the id that the next begins after
                    pairs.add(flat[:-1] * subwords.size + flat[1:])
                for kind, sums in ((0, words), (1, pairs)):
                    if sums.size > HELD_KEYS:
                        yield sent(kind, *sums.total())
                        sums.held, sums.size = [], 0
        if arrow_id is not None:
            yield sent(0, *words.total())
            yield sent(1, *pairs.total())
            yield sent(2, np.zeros(1, np.int64), np.array([docs]))

    both = written(rows.mapInArrow(run, f"id {id_type.simpleString()}, held_out boolean, text string, ids binary, kind int, key long, c long"), compression="zstd")  # all texts and ids
    counted = both.where("kind is not null").groupBy("kind", "key").agg(F.sum("c").alias("c"))
    return both.where("kind is null").select("id", "held_out", "text", "ids"), written(counted)


def pair_table(pairs: DataFrame, size: int, left: np.ndarray, right: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Counts of pairs of ids by what ``left`` and ``right`` make of their first and second; no more rows than ``shape`` come."""
    sent = pairs.sparkSession.sparkContext.broadcast((left, right))  # the vocabulary

    def run(batches):
        forget()
        left, right = sent.value
        sums = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            key, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = left[key // size] * shape[1] + right[key % size]
            sums += np.bincount(at, c, len(sums)).astype(np.int64)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], names=["k", "c"])

    got = pairs.select("key", "c").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(shape[0] * shape[1], np.int64)
    out[got.column("k").to_numpy()] = got.column("c").to_numpy()
    return out.reshape(shape)


def classes(n: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
    """From counts of ids and counts of bucket and id: class of each id, its kind as input, log of its share of the class after each bucket."""
    size = len(n)
    order = np.lexsort((np.arange(size), -n))
    cls = np.zeros(size, np.int64)
    own, rest = order[:OWN_CLASSES], order[OWN_CLASSES:]
    cls[own] = np.arange(len(own))
    by = after.T.astype(np.float32)
    x = np.sqrt((by + 0.1) / (by + 0.1).sum(axis=1, keepdims=True))
    if len(rest):
        centre = x[rest[:GROUPS]]
        weight = n[rest] + 0.1
        for _ in range(8):
            near = np.argmax(x[rest] @ centre.T, axis=1)
            centre = np.stack([np.bincount(near, weight * x[rest, b], len(centre)) for b in range(x.shape[1])], axis=1)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        cls[rest] = OWN_CLASSES + near
    kind = KINDS + np.maximum(cls - OWN_CLASSES, 0)  # ids without a kind of their own have that of their class
    kind[order[:KINDS]] = np.arange(min(KINDS, size))
    share = (n + SMOOTH) / np.bincount(cls, n + SMOOTH, CLASSES)[cls]
    total = np.stack([np.bincount(cls, after[b], CLASSES) for b in range(BUCKETS)], axis=1)
    share = np.log((by + SHARE_SMOOTH * share[:, None]) / (total[cls] + SHARE_SMOOTH))
    return {"cls": cls, "kind": kind, "share": share.astype(np.float32), "classes": np.bincount(cls, n + SMOOTH, CLASSES) / (n + SMOOTH).sum()}


def buckets(n: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(n)), -n))
    out = np.full(len(n), BUCKETS - 1)
    out[order[: BUCKETS - 1]] = np.arange(min(BUCKETS - 1, len(n)))
    return out


def learned_tables(counted: DataFrame, size: int) -> dict[str, np.ndarray]:
    """All that is counted of pairs of ids, as arrays over the vocabulary."""
    pairs = counted.where("kind = 1")
    everything = np.zeros(size, np.int64)
    n = pair_table(pairs, size, everything, np.arange(size), (1, size))[0]
    bucket = buckets(n)
    tables = classes(n, pair_table(pairs, size, bucket, np.arange(size), (BUCKETS, size))) | {"bucket": bucket}
    follow = pair_table(pairs, size, tables["kind"], tables["cls"], (INPUTS, CLASSES))
    shares = np.maximum(tables.pop("classes"), 1e-12)  # a class that no id is in is never a target
    tables["prior"] = np.log((follow + CLASS_SMOOTH * shares) / (follow.sum(axis=1, keepdims=True) + CLASS_SMOOTH)).astype(np.float32)
    tables["ids"] = n.sum()
    return tables


def exponentials(s: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Exponentials along the last axis, their sums, and the logarithm of a factor that both lack (None: none); the largest is taken off first only where they would not fit. out: where they go."""
    ones = np.ones(s.shape[-1], s.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(s, out=out)
    total = e @ ones
    if total.size and not (total.min() > 1e-6 and total.max() < 1e30):
        top = s.max(axis=-1)
        e = np.exp(s - top[..., None], out=out)
        return e, e @ ones, top
    return e, total, None


class Attention:
    """One head of causal self-attention beside the counted logarithms ``prior``; input INPUTS is the start."""

    START = INPUTS
    SHAPES = {"E": (INPUTS + 1, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "R": (LENGTH,), "O": (WIDTH, CLASSES), "b": (CLASSES,)}

    def __init__(self, params: np.ndarray, prior: np.ndarray):
        self.p, self.prior = self.parts(params.astype(np.float32)), prior
        gap = np.arange(LENGTH)[:, None] - np.arange(LENGTH)
        self.gap, self.past = np.maximum(gap, 0), gap >= 0

    @classmethod
    def parts(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one array of all parameters."""
        ends = np.cumsum([0, *[int(np.prod(x)) for x in cls.SHAPES.values()]]).tolist()
        return {n: flat[low:high].reshape(x) for (n, x), low, high in zip(cls.SHAPES.items(), ends, ends[1:], strict=False)}

    @classmethod
    def start(cls) -> np.ndarray:
        """Attention that adds nothing yet."""
        rng = np.random.default_rng(0)
        parts = [(rng.normal(0, 0.3 if n == "E" else 0.25, s) if n in "EQK" else np.zeros(s)).ravel() for n, s in cls.SHAPES.items()]
        return np.concatenate(parts).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES])

    def shared(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What all windows use: queries and keys as one matrix, the weights of distances, what gives classes (its last row for a one beside the width)."""
        p = self.p
        distance = np.where(self.past, p["R"][self.gap], np.float32(-1e9))[:length, :length]
        return p["Q"] @ p["K"].T * WIDTH**-0.5, distance, np.vstack([p["O"], p["b"]])

    def forward(self, z: np.ndarray, last: np.ndarray, wanted: np.ndarray, shared: tuple[np.ndarray, ...]):
        """What each step gives; the last four only for the ``wanted`` positions (flat). z: inputs, last: kinds of the ids before the targets."""
        between, distance, given = shared
        x = self.p["E"][z]
        turned = np.ascontiguousarray(x.transpose(0, 2, 1))
        s = (x.reshape(-1, WIDTH) @ between).reshape(x.shape) @ turned
        s += distance
        a, total, _ = exponentials(s)
        y = a @ x
        y /= total[..., None]
        taken = np.ones((len(wanted), WIDTH + 1), x.dtype)
        taken[:, :WIDTH] = y.reshape(-1, WIDTH)[wanted]
        logits = self.prior.take(last.ravel()[wanted], axis=0)
        room = taken @ given
        logits += room
        return x, turned, a, total, y, taken, logits, *exponentials(logits, room)

    def log_prob(self, z: np.ndarray, last: np.ndarray, target: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithm of the probability of each target class, or of those at the wanted positions, in order."""
        shared, out = self.shared(z.shape[1]), []
        for i in range(0, len(z), SIDE_BY_SIDE):
            now = slice(i, i + SIDE_BY_SIDE)
            at = np.arange(target[now].size) if wanted is None else np.flatnonzero(wanted[now])
            *_, logits, _, total, top = self.forward(z[now], last[now], at, shared)
            p = logits[np.arange(len(at)), target[now].ravel()[at]] - np.log(total)
            out.append(p if top is None else p - top)
        p = np.concatenate(out)
        return p.reshape(target.shape) if wanted is None else p

    def gradients(self, z: np.ndarray, last: np.ndarray, target: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the valid targets. Windows go through a few at a time, whose arrays stay in the processor's cache."""
        p, n, count = self.p, z.shape[1], max(1, int(valid.sum()))
        between, distance, given = shared = self.shared(n)
        back, db, ds_sum, dgiven, rows = np.ascontiguousarray(p["O"].T), np.zeros_like(between), np.zeros_like(distance), np.zeros_like(given), []
        for i in range(0, len(z), SIDE_BY_SIDE):
            now = slice(i, i + SIDE_BY_SIDE)
            at = np.flatnonzero(valid[now])
            x, turned, a, total, y, taken, _, d, sums, _ = self.forward(z[now], last[now], at, shared)
            d *= (1 / (sums * count))[:, None]
            d[np.arange(len(at)), target[now].ravel()[at]] -= 1 / count
            dgiven += taken.T @ d
            dy = np.zeros_like(y)
            dy.reshape(-1, WIDTH)[at] = d @ back
            dy /= total[..., None]
            ds = dy @ turned
            ds -= np.einsum("ijk,ijk->ij", dy, y)[..., None]
            ds *= a
            ds_sum += ds.sum(axis=0)
            left, right = (ds @ x).reshape(-1, WIDTH), (ds.transpose(0, 2, 1) @ x).reshape(-1, WIDTH)
            db += x.reshape(-1, WIDTH).T @ left
            rows.append((a.transpose(0, 2, 1) @ dy).reshape(-1, WIDTH) + left @ between.T + right @ between)
        db *= WIDTH**-0.5
        cells = (z.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        e = np.bincount(cells, np.concatenate(rows).ravel(), p["E"].size).reshape(p["E"].shape)
        return {"E": e, "Q": db @ p["K"], "K": db.T @ p["Q"], "R": np.bincount(self.gap[:n, :n].ravel(), ds_sum.ravel(), LENGTH), "O": dgiven[:-1], "b": dgiven[-1]}


class Trainer:
    """Adam, with a rate that rises over WARM_UP steps and falls to a tenth over all."""

    def __init__(self, model: Attention, steps: int):
        self.model, self.steps, self.t = model, steps, 0
        self.x = model.flat()
        model.p = model.parts(self.x)
        self.m, self.v = np.zeros_like(self.x), np.zeros_like(self.x)

    def step(self, z, last, target, valid) -> None:
        self.t += 1
        rate = RATE * min(1.0, self.t / WARM_UP) * max(0.1, 1 - self.t / self.steps)
        got = self.model.gradients(z, last, target, valid)
        g = np.concatenate([got[n].ravel() for n in self.model.SHAPES]).astype(np.float32)
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.x -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


def windows(sizes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position in its text, text, and first position to score of each window."""
    n = 1 + np.maximum(0, -(-(sizes - LENGTH) // stride))
    n = np.where(sizes > 0, n, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return k * stride, text, np.where(k > 0, k * stride + LENGTH - stride, 0)


def batches_of(ids: np.ndarray, sizes: np.ndarray, tables: dict, batch: int, stride: int = STRIDE, order: np.ndarray | None = None):
    """Windows in batches: place of each id, inputs, kinds of the ids before, target classes, which targets are to be scored."""
    low, text, scored = windows(sizes, stride)
    if order is not None:
        low, text, scored = low[order], text[order], scored[order]
    first, size = (np.cumsum(sizes) - sizes)[text], sizes[text]
    before, cls = tables["kind"].astype(np.int16)[before_each(ids)], tables["cls"].astype(np.int16)[ids]
    inputs = before.copy()
    inputs[first] = Attention.START
    for i in range(0, len(low), batch):
        now = slice(i, i + batch)
        at = low[now, None] + np.arange(LENGTH)
        place = np.minimum(first[now, None] + at, len(ids) - 1)  # what is beyond the text is after all that is scored
        yield place, inputs[place].astype(np.intp), before[place], cls[place], (at < size[now, None]) & (at >= scored[now, None])


def before_each(ids: np.ndarray) -> np.ndarray:
    """The id before each: a text ends with the end id, which the next begins after."""
    return np.append(ids[-1:], ids[:-1])


def trained(params: np.ndarray, tables: dict, texts: list[bytes], stored: str) -> tuple[np.ndarray, int]:
    """Parameters after one pass over every id of the texts, and the number of ids."""
    texts = sorted(texts, key=lambda x: (xxhash.xxh64_intdigest(x), len(x)))
    ids, sizes = np.frombuffer(b"".join(texts), stored), np.array([len(x) // np.dtype(stored).itemsize for x in texts], np.int64)
    n = len(windows(sizes, LENGTH)[0])
    model = Attention(params, tables["prior"])
    trainer = Trainer(model, -(-n // BATCH))
    for _, z, last, target, valid in batches_of(ids, sizes, tables, BATCH, LENGTH, np.random.default_rng(n).permutation(n)):
        trainer.step(z, last, target, valid)
    return model.flat(), len(ids)


FRACTION = 1 << 24  # parameters are added as whole numbers of this part, weighted by thousands of ids


def train(rows: DataFrame, tables: dict, stored: str) -> np.ndarray:
    """rows: id and ids of the training documents."""
    shards = max(1, -(-int(tables["ids"]) // SHARD_IDS))
    held = rows.select("ids", F.pmod(F.xxhash64("id", "ids"), F.lit(shards)).cast("int").alias("shard"))
    params = Attention.start()
    for chosen in (held.where("shard = 0"), held.where("shard > 0"))[: 1 if shards == 1 else 2]:
        sent = rows.sparkSession.sparkContext.broadcast((params, {k: tables[k] for k in ("kind", "cls", "bucket", "prior")}))  # the vocabulary's size

        def run(table):
            forget()
            params, tables = sent.value
            got, seen = trained(params, tables, table.column("ids").to_pylist(), stored)  # about SHARD_IDS ids
            weight = max(1, seen >> 10)
            return pa.table({"i": pa.array(np.arange(len(got))), "x": pa.array(np.rint(got.astype(float) * FRACTION).astype(np.int64) * weight), "w": pa.array(np.full(len(got), weight))})

        summed = chosen.groupBy("shard").applyInArrow(run, "i long, x long, w long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
        got = summed.toArrow()  # a row for each parameter
        if len(got):
            i, x, w = [got.column(c).to_numpy() for c in ("i", "x", "w")]
            params = params.copy()
            params[i] = x / w / FRACTION
    return params


class Scorer:
    def __init__(self, params: np.ndarray, tables: dict):
        self.model, self.tables = Attention(params, tables["prior"]), tables

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        p = self.tables["share"][ids, self.tables["bucket"][before_each(ids)]].astype(float)
        for place, z, last, target, valid in batches_of(ids, sizes, self.tables, SCORED_AT_ONCE):
            p[place[valid]] += self.model.log_prob(z, last, target, valid)  # each id is in one window alone
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), p, len(sizes)) / np.log(10)


def score(docs: DataFrame, path: str, pattern: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the rows that are not held out."""
    spark, make = docs.sparkSession, (path, pattern)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    coded, counted = encoded(rows, make)
    words = counted.where("kind = 0").select(F.col("key").alias("w"), "c")
    n_docs = (counted.where("kind = 2").agg(F.sum("c")).first()[0]) or 0
    n_words, n_distinct = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    total, distinct_tokens = n_words + n_docs, n_distinct + (n_docs > 0)
    norm = float(np.log10(total + distinct_tokens + 1))
    subwords = Subwords(*make)
    stored, tables = subwords.stored, learned_tables(counted, subwords.size)
    del subwords
    params = train(coded.where("not held_out").select("id", "ids"), tables, stored)
    top = words.orderBy(F.desc("c"), "w").limit(MAX_COMMON).toArrow()
    keys, c = top.column("w").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], c[order], params, tables, n_docs))  # MAX_COMMON words and the vocabulary
    key = ("attention", uuid.uuid4().hex)

    def run(batches):
        forget("attention")
        common, times, params, tables, n_docs = sent.value
        scorer = worker_state(key, lambda: Scorer(params, tables))
        row = TaskContext.get().partitionId() << 40
        log_known = np.log10(np.append(times, 0) + 1.0)
        names = ["r", "id", "held_out", "n_tokens", "n_known", "base", "score", "w", "m"]
        for batch in batches:
            for low, texts in text_runs(batch.column(2)):
                k, there = len(texts), [batch.column(i).slice(low, len(texts)) for i in (0, 1)]
                h, n = word_hashes(texts)
                different, at = np.unique(h.view(np.int64), return_inverse=True)
                place = np.minimum(np.searchsorted(common, different), max(len(common) - 1, 0))
                is_common = common[place] == different if len(common) else np.zeros(len(different), bool)
                place = np.where(is_common, place, len(common))
                owner = np.repeat(np.arange(k), n)
                base = np.bincount(owner, log_known[place[at]], k) + np.log10(n_docs + 1.0)
                known = np.bincount(owner, is_common[at], k).astype(np.int64) + (n_docs > 0)
                coded = batch.column(3).slice(low, k).to_pylist()
                ids = np.frombuffer(b"".join(coded), stored).astype(np.int64)
                scored = scorer(ids, np.array([len(x) // np.dtype(stored).itemsize for x in coded], np.int64))
                r = row + np.arange(k)
                row += k
                rare = np.flatnonzero(~is_common[at])
                pair, m = np.unique(owner[rare] * max(len(different), 1) + at[rare], return_counts=True)
                rare_row, rare_word = r[pair // max(len(different), 1)], different[pair % max(len(different), 1)]
                kinds = [pa.int64(), there[0].type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                docs_part = [pa.array(r), *there, pa.array(n + 1), pa.array(known), pa.array(base), pa.array(scored), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
                word_part = [pa.array(rare_row), *[pa.nulls(len(pair), x) for x in kinds[1:7]], pa.array(rare_word), pa.array(m.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(docs_part, names=names)
                yield pa.RecordBatch.from_arrays(word_part, names=names)

    id_type = rows.schema["id"].dataType.simpleString()
    both = written(coded.mapInArrow(run, f"r long, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, w long, m long"))
    rest = both.where("w is not null").select("r", "w", "m").join(words, "w")
    rest = rest.groupBy("r").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("m").alias("found"))
    out = both.where("w is null").join(rest, "r", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )


def held_out(column: str, by: int = 7, rest: int = 2) -> Column:
    return remainder(column, by) == rest
