"""Benchmark decontamination with a generalised suffix automaton (operator 5).

The words of test items go into one automaton. A document's words run through it; the state says how long the longest
run of words is that ends here and stands in some item. Runs of ``window`` words or more, and whole shorter items, are hits.

The automaton is built on the driver from items that are streamed, SHARD_WORDS words at a time, and sent as flat arrays; each shard is a pass
of its own over the documents, its hits joined to those before. So neither the driver nor a worker ever holds more than one shard.

Null texts and texts without words have no words and no hits; very long texts take memory in proportion to themselves. Items without
words are ignored; items with equal texts are all named; items with equal ids count once; a null id is named 'null'. Documents that
repeat are treated alike, and empty tables give no rows or no hits. Columns of ``find_hits`` take the place of columns of their names;
``decontaminate`` leaves all other columns as they are, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import forget, text_runs, worker_state, written

#: ASCII letters become small, digits and what is not ASCII stay, all else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words in the text as it stands.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of the items of one automaton; at about 1 kB a word while it is built, a tenth of that when sent.
SHARD_WORDS = 250_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split()


class SuffixAutomaton:
    """Of several sequences of word numbers, while it is built."""

    def __init__(self, items: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.size, self.back = [0], [-1]
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)

    def _state(self, size: int, step: dict, back: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.back.append(back)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for its runs that p's runs and ``word`` make."""
        copy = self._state(self.size[p] + 1, dict(self.step[q]), self.back[q])
        self.back[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.back[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:  # another item has this run already
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.back[p]
        if p >= 0:
            q = self.step[p][word]
            self.back[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def flat(self, items: list[list[int]], window: int) -> dict[str, np.ndarray]:
        """Arrays: size and back of states, edges (state, word, next), items of the states that are windows, whole short items of states."""
        size, back = self.size, self.back
        windows, whole = set(), set()
        for k, item in enumerate(items):
            state = 0
            for at, word in enumerate(item):
                state = self.step[state][word]
                if at + 1 >= window:
                    v = state
                    while size[back[v]] >= window:
                        v = back[v]
                    windows.add((v, k))
            if 0 < len(item) < window:
                whole.add((state, k))
        edges = [(v, w, q) for v, step in enumerate(self.step) for w, q in step.items()]
        two, three = np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)
        return {"size": np.array(size, np.int32), "back": np.array(back, np.int32), "edges": np.array(edges, np.int32) if edges else three, "windows": np.array(sorted(windows), np.int32) if windows else two, "whole": np.array(sorted(whole), np.int32) if whole else two}


class Matcher:
    """What a worker makes of the arrays of an automaton and of the words that its numbers stand for."""

    def __init__(self, words: list[bytes], flat: dict[str, np.ndarray], window: int):
        self.window, self.number = window, {w: i for i, w in enumerate(words)}
        self.size, self.back = flat["size"].tolist(), flat["back"].tolist()
        n = self.n = max(1, len(words))
        state, word, to = flat["edges"].astype(np.int64).T
        self.step = dict(zip((state * n + word).tolist(), to.tolist(), strict=True))
        #: state -> numbers of the items in which the window that it is stands; of the whole items that it is
        self.items: dict[int, list[int]] = {}
        self.whole: dict[int, list[int]] = {}
        for to, rows in ((self.items, flat["windows"]), (self.whole, flat["whole"])):
            for v, k in rows.tolist():
                to.setdefault(v, []).append(k)
        #: state -> the nearest of itself and its suffixes that is a whole short item
        self.short = [-1] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.short[v] = v if v in self.whole else self.short[self.back[v]]

    def hits(self, words: Iterable[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, disjoint and ascending, ends exclusive; numbers of the items with a window in the text."""
        step, size, back, short, window, n = self.step, self.size, self.back, self.short, self.window, self.n
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = length = 0
        for i, number in enumerate(map(self.number.get, words)):
            if number is None:  # in no item
                state = length = 0
                continue
            following = step.get(state * n + number)
            if following is not None:
                state, length = following, length + 1
            else:
                while True:  # the root knows every word of the items
                    state = back[state]
                    following = step.get(state * n + number)
                    if following is not None:
                        length = size[state] + 1
                        state = following
                        break
            if length >= window:
                self._mark(spans, i + 1 - length, i + 1)
                v = state
                while size[back[v]] >= window:
                    v = back[v]
                found.update(self.items[v])
            v = short[state]
            while v >= 0:
                if size[v] <= length:
                    self._mark(spans, i + 1 - size[v], i + 1)
                    found.update(self.whole[v])
                v = short[back[v]]
        return spans, found

    @staticmethod
    def _mark(spans: list, low: int, high: int) -> None:
        while spans and spans[-1][1] >= low:
            low = min(low, spans.pop()[0])
        spans.append((low, high))


def matcher_parts(items: list[list[bytes]], window: int) -> tuple[list[bytes], dict[str, np.ndarray], int]:
    """The arguments of a Matcher of these items."""
    number: dict[bytes, int] = {}
    coded = [[number.setdefault(w, len(number)) for w in item] for item in items]
    return list(number), SuffixAutomaton(coded).flat(coded, window), window


def shards(items: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """Ids and words of the items with words, at most about ``shard_words`` words at a time; an item that is longer is alone."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    names, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if words:
            if texts and size + len(words) > shard_words:
                yield names, texts
                names, texts, size = [], [], 0
            names.append(row["i"])
            texts.append(words)
            size += len(words)
    yield names, texts


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with the columns ``names``: number of words, spans (array of start and end, in words) and items (array of item ids as text, sorted)."""
    made = T.StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` array<struct<start:long,end:long>>, `{names[2]}` array<string>")
    taken = [f for f in docs.schema if f.name not in names]
    schema = T.StructType([*taken, *made])
    arrow = to_arrow_schema(schema)
    at = [f.name for f in taken].index(text_col)
    out = docs.select(*[F.col(f"`{f.name}`") for f in taken])
    for k, (ids, texts) in enumerate(shards(items, item_id_col, item_text_col, shard_words)):
        if k:
            out = written(out)
        key = ("suffix automaton", uuid.uuid4().hex)
        sent = docs.sparkSession.sparkContext.broadcast((ids, matcher_parts(texts, window)))  # at most shard_words words, or one item

        def run(batches, sent=sent, key=key, first=not k):
            forget(key[0])
            ids = sent.value[0]
            matcher = worker_state(key, lambda: Matcher(*sent.value[1]))
            for batch in batches:
                for low, texts in text_runs(batch.column(at)):
                    had = batch.slice(low, len(texts))
                    old = [None] * len(texts) if first else list(zip(had.column(len(taken) + 1).to_pylist(), had.column(len(taken) + 2).to_pylist(), strict=True))
                    sizes, spans, found = [], [], []
                    for text, before in zip(texts, old, strict=True):
                        words = words_of(text)
                        s, f = matcher.hits(words)
                        of = {ids[j] for j in f}
                        if before:
                            s = merged(s + [(x["start"], x["end"]) for x in before[0]])
                            of.update(before[1])
                        sizes.append(len(words))
                        spans.append([{"start": a, "end": b} for a, b in s])
                        found.append(sorted(of))
                    new = [pa.array(x, arrow.field(len(taken) + i).type) for i, x in enumerate((sizes, spans, found))]
                    yield pa.RecordBatch.from_arrays([*[had.column(i).cast(arrow.field(i).type) for i in range(len(taken))], *new], schema=arrow)

        out = out.mapInArrow(run, schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def report(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    hits = find_hits(docs.select(id_col, "text"), items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words and the space before each."""
    at = [m.span() for m in WORD.finditer(text)]
    out, low = [], 0
    for a, b in spans:
        out.append(text[low : at[a][0]].rstrip(" "))
        low = at[b - 1][1]
    return "".join([*out, text[low:]])


def cut(hits: DataFrame, columns: list[str], text_col: str, spans: str) -> DataFrame:
    """The ``columns`` of rows with spans, their texts without them."""
    schema = hits.select(*[F.col(f"`{c}`") for c in columns]).schema
    arrow, at = to_arrow_schema(schema), columns.index(text_col)

    def run(batches):
        forget()
        for batch in batches:
            for low, texts in text_runs(batch.column(at)):
                had = batch.slice(low, len(texts))
                left = [cut_words(t, [(s["start"], s["end"]) for s in ss]) for t, ss in zip(texts, had.column(len(columns)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()).cast(arrow.field(i).type) if i == at else had.column(i).cast(arrow.field(i).type) for i in range(len(columns))], schema=arrow)

    return hits.select(*[F.col(f"`{c}`") for c in [*columns, spans]]).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without what stands in the items: a document of which more than ``max_coverage`` of the words is hit goes, from others the hit spans go.

    Cutting a span brings the words around it together; what was cut is searched again until nothing is hit. Each time texts get shorter, so this ends.
    """
    columns = docs.columns
    mark = uuid.uuid4().hex[:8]  # no column of the documents has these names
    names = (f"n_{mark}", f"spans_{mark}", f"items_{mark}")
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    own = [F.col(f"`{c}`") for c in columns]
    found = written(find_hits(docs, items, window, text_col, shard_words=shard_words, names=names))
    done = found.where(F.size(names[1]) == 0).select(*own)
    while True:
        hit = found.where((F.size(names[1]) > 0) & (n_hit <= max_coverage * F.col(names[0])))
        if hit.isEmpty():
            return done
        found = written(find_hits(cut(hit, columns, text_col, names[1]), items, window, text_col, shard_words=shard_words, names=names))
        done = done.unionByName(found.where(F.size(names[1]) == 0).select(*own))
