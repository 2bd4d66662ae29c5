"""Spelling variant grouping by a symmetric-delete join (operator 11).

Every word emits itself and each distinct word that one deletion leaves, as 64-bit keys: running sums over all code points of a batch give
the key of every deletion in one step each, so a very long word takes time and memory in proportion to its length. Words that share
a key are candidates (a key has at most one word for each place and letter, so no key is hot), and an exact edit distance of one is
verified on the words themselves. A word's form is its most frequent near word if that is FACTOR times as frequent; forms are followed to
their roots by joins that double the distance each time.

Words are runs of letters; a run that the given rule draws loses one code point first, so that variants are there to be found. Null texts have no words. A null id is empty text in
the rule. Repeated rows count once each. Ties go to the smallest word in code-point order. Very long texts take memory in proportion to themselves. An empty table, or
one without repeated words, gives an empty result. Further columns, of any names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, written

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_COUNT, FACTOR, DRAWN = 7, 2, 10, 31
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points of words that a task works on at once.
RUN_POINTS = 1_000_000

BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def drawn_runs(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """doc and w of every run of at least LEAST_LENGTH letters, A-Z lowered; the others cannot become words."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("w"))
    return rows.select("doc", F.when(F.col("w").rlike("[A-Z]"), F.translate("w", UPPER, LOWER)).otherwise(F.col("w")).alias("w"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words, added up within each task before they are shuffled."""
    h = F.crc32(F.concat_ws(":", "doc", "w"))
    at = (h % F.length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    rows = drawn_runs(docs, id_col, text_col).select(F.when(h % DRAWN == 0, less).otherwise(F.col("w")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key) of every word itself and of each distinct word that one deletion leaves."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(points)) - start[owner]
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max(initial=0)), BASE, np.uint64)))  # wraps
    value = mix(points + np.uint64(1)) * power[place]
    total = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
    whole = total[start + size] - total[start]
    before, after = total[:-1] - total[start][owner], total[(start + size)[owner]] - total[1:]
    left = before + after * np.uint64(INVERSE)  # what follows moves up by one
    # of equal neighbours, deleting the first leaves the same as deleting any
    once = (place == 0) | (points != np.append(np.uint64(0), points[:-1]))
    key = np.concatenate([mix(whole + size.astype(np.uint64) * np.uint64(BASE)), mix(left[once] + (size[owner[once]] - 1).astype(np.uint64) * np.uint64(BASE))])
    return np.concatenate([np.arange(len(texts)), owner[once]]), key.view(np.int64)


def keyed(found: DataFrame) -> DataFrame:
    """key, word and n: a row for each key of each word."""

    def run(batches):
        forget()
        for batch in batches:
            texts, low, held = batch.column(0).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= RUN_POINTS or i == len(texts) - 1:
                    owner, key = deletion_keys(texts[low : i + 1])
                    here = pa.array(owner + low)
                    for at in range(0, len(here), 1 << 18):
                        some = here.slice(at, 1 << 18)
                        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 18)]), batch.column(0).take(some), batch.column(1).take(some)], names=["key", "word", "n"])
                    low, held = i + 1, 0

    return found.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near(found: DataFrame) -> DataFrame:
    """a, na, b and nb of all pairs of near words, each in both directions."""
    keys = keyed(found)
    left, right = keys.toDF("key", "a", "na"), keys.toDF("key", "b", "nb")
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = written(left.join(right, "key").where(close).select("a", "na", "b", "nb").distinct())
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows word and form. A form is FACTOR times as frequent as its word, so chains end; each join doubles the steps that are behind."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = written(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    found = written(words(docs, id_col, text_col))
    best = near(found).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("order"), F.col("b").alias("b"))).alias("best"))
    rows = found.join(best.withColumnRenamed("a", "word"), "word", "left")
    form_n = -F.col("best.order")
    enough = form_n >= FACTOR * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, form_n).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
