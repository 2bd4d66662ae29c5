"""Language identification by rank-order profiles (operator 3).

A profile is the list of a language's most frequent n-grams (1 to 3 characters of padded words) in order of frequency. A
document's own list is compared with each: every n-gram adds how far its rank is out of place, or the most possible where the
profile lacks it. The language at the least distance is the answer.

Ties in frequency go by the n-gram, ties in distance by the language's name. Null texts and texts without a letter are `und`
with score 0, and so is everything where nothing was learned. Null languages teach nothing; '' is a language like any other.
Repeated rows count each time. Only text enters a prediction. Very long texts take memory in proportion to themselves. Further columns, of any names, are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_texts, remainder, text_runs, written

#: N-grams of a profile and of a document's list.
PROFILE = 400
#: Languages at most; more would make the profiles that every worker holds too large, and is an error.
MAX_LANGUAGES = 2_000
#: Texts whose n-grams are counted in one step, in characters, unless one text is longer.
STEP_CHARS = 300_000
#: N-grams that a counting task holds before it sends them on.
MAX_GRAMS = 1_000_000
BITS = 21  # of a code point
PAD = ord("_")

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pack(gram: str) -> int:
    """Code points side by side from the left: numbers are in the order of the strings."""
    return sum(ord(c) << BITS * (2 - i) for i, c in enumerate(gram))


def unpack(number: int) -> str:
    return "".join(chr(c) for i in (2, 1, 0) if (c := number >> BITS * i & (1 << BITS) - 1))


def steps(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > STEP_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def gram_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the n-grams in ascending order, counts by text and n-gram): 1 to 3 characters of each run of letters with a pad on either side."""
    lowered = [t.lower() for t in texts]
    c = np.frombuffer(("\n" + "".join([t + "\n" for t in lowered])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    doc = np.append(0, doc)
    c = np.where(letters()[c], c, PAD)
    alphabet, x = np.unique(c, return_inverse=True) if len(c) < 1000 else dense(c)
    a, pad = len(alphabet), int(np.searchsorted(alphabet, PAD))
    letter = x != pad
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    # the text of a pair with a pad before its letter is that of the letter
    owner = np.concatenate([doc[one], doc[np.where(letter[two], two, two + 1)], doc[three + 1]])
    code = np.concatenate([x[one], a + x[two] * a + x[two + 1], a + a * a + (x[three] * a + x[three + 1]) * a + x[three + 2]])
    used, number = np.unique(code, return_inverse=True) if a > 120 else dense(code)
    p = np.append(alphabet, 0)
    n1, n2 = used < a, (used >= a) & (used < a + a * a)
    u2, u3 = used - a, used - a - a * a
    packed = np.where(n1, p[np.where(n1, used, 0)] << 2 * BITS, np.where(n2, (p[np.where(n2, u2 // a, 0)] << 2 * BITS) | (p[np.where(n2, u2 % a, 0)] << BITS), 0))
    n3 = ~n1 & ~n2
    u3 = np.where(n3, u3, 0)
    packed = np.where(n3, (p[u3 // (a * a)] << 2 * BITS) | (p[u3 // a % a] << BITS) | p[u3 % a], packed)
    order = np.argsort(packed)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    g = max(len(used), 1)
    counts = np.bincount(owner * g + place[number], minlength=len(texts) * g).reshape(len(texts), g)[:, : len(used)]
    return packed[order], counts


def dense(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse for small numbers, without a sort."""
    used = np.flatnonzero(np.bincount(x))
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    number[used] = np.arange(len(used))
    return used, number[x]


def gram_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram and n over all rows with a language: each task sends an n-gram once for each language."""

    def count(batches):
        forget()
        sums: dict[str, Counter] = {}

        def emptied():
            for lang, n in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "gram": pa.array(map(unpack, n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        for batch in batches:
            for low, texts in text_runs(batch.column(1)):
                langs, at = np.array(batch.column(0).slice(low, len(texts)).to_pylist(), object), 0
                for some in steps(texts):
                    grams, counts = gram_table(some)
                    of = langs[at : at + len(some)]
                    at += len(some)
                    for lang in set(of):
                        n = counts[of == lang].sum(axis=0)
                        hit = np.flatnonzero(n)
                        sums.setdefault(lang, Counter()).update(dict(zip(grams[hit].tolist(), n[hit].tolist(), strict=True)))
                if sum(map(len, sums.values())) > MAX_GRAMS:
                    yield from emptied()
                    sums = {}
        yield from emptied()

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, size: int = PROFILE, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[str]]:
    """Profiles of the languages of ``df``: bounded by MAX_LANGUAGES lists of ``size`` n-grams."""
    order = [F.desc("n"), "gram"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)  # a language may hold most rows
    first = gram_counts(df, lang_col, text_col).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= size)
    top = written(first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size))
    if (n := top.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; profiles are held for {MAX_LANGUAGES} at most")
    profiles: dict[str, list[tuple[int, str]]] = {}
    for row in top.collect():
        profiles.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: [g for _, g in sorted(x)] for lang, x in sorted(profiles.items())}


class Classifier:
    def __init__(self, profiles: dict[str, list[str]], size: int):
        self.languages, self.size = list(profiles), size
        #: of each language the n-grams' numbers, ascending, and their ranks
        self.profiles = []
        for grams in profiles.values():
            numbers = np.array([pack(g) for g in grams], np.int64)
            order = np.argsort(numbers)
            self.profiles.append((numbers[order], order))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        grams, counts = gram_table(texts)
        n = len(grams)
        if not n or not self.languages:
            return [("und", 0.0)] * len(texts)
        ranks = np.full((len(self.languages), n + 1), -1, np.int64)  # the last column is for no n-gram
        for row, (numbers, order) in zip(ranks, self.profiles, strict=True):
            at = np.minimum(np.searchsorted(numbers, grams), len(numbers) - 1)
            row[:n] = np.where(numbers[at] == grams, order[at], -1)
        key = counts * (n + 1) + np.arange(n, 0, -1) * (counts > 0)  # by count, then by n-gram
        top = -np.sort(-np.partition(key, n - self.size, axis=1)[:, n - self.size :], axis=1) if n > self.size else -np.sort(-key, axis=1)
        listed = top > 0
        gram = np.where(listed, n - top % (n + 1), n)
        held = listed.sum(axis=1)
        away = np.empty((len(self.languages), len(texts)), np.int64)
        for k, row in enumerate(ranks):
            r = row[gram]
            away[k] = np.where(listed, np.where(r < 0, self.size, np.abs(r - np.arange(gram.shape[1]))), 0).sum(axis=1)
        best = away.argmin(axis=0)
        return [(self.languages[b], 1.0 - float(away[b, i]) / (self.size * h)) if h else ("und", 0.0) for i, (b, h) in enumerate(zip(best.tolist(), held.tolist(), strict=True))]


def identify(df: DataFrame, profiles: dict[str, list[str]], keep: list[str], size: int = PROFILE, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row."""

    def make():
        classifier = Classifier(profiles, size)
        return lambda texts: list(zip(*[x for some in steps(texts) for x in classifier.predict(some)], strict=True))

    key = ("language profiles", size, hashlib.sha256(repr(profiles).encode()).hexdigest())
    return map_texts(df, keep, text_col, make, key, "lang_pred string, score double")


def held_out(column: str, by: int = 5, rest: int = 0) -> Column:
    return remainder(column, by) == rest


def evaluate(df: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0, predict all."""
    profiles = learn(df.where(~held_out("doc_id")))
    rows = df.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return identify(rows, profiles, ["doc_id", "held_out"])
