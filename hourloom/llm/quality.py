"""Quality rules with n-gram perplexity (operator 6).

The model is a modified Kneser-Ney model of the characters of word sequences, one for each language: n-grams of ORDER characters of
the lower-cased words of a text, one after another with a mark at each border, are counted by Spark over the whole corpus, the counts of lower orders and the discounts are worked
out from them, and joins give each counted n-gram its probability. Workers get those of the MAX_GRAMS most frequent n-grams as sorted
arrays of 64-bit hashes; those of all others are joined to the documents, so no count is dropped at any size. A document's perplexity
is that of all characters of its words and of their borders; each language has a lower and an upper bound, taken from the quartiles of the logarithms of the
perplexities of its documents, and a document outside is rejected, as is one that fails the base rules.

Null texts have no words: they fail the base rules. A null language is a language of its own. Languages with fewer than
MIN_DOCS documents are judged by the quartiles of all documents; documents with fewer than MIN_WORDS words fail the base rules. Repeated rows are
judged alike, ties at a bound are kept, a very long text takes memory in proportion to itself, an empty table gives an empty result. Other columns
are untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, small, text_runs, written

ORDER = 4
#: Characters that are hashed side by side: each takes about 70 bytes meanwhile.
RUN_CHARS = 500_000
#: Hashed n-grams that workers hold, over all languages; the others are joined.
MAX_GRAMS = 3_000_000
MIN_DOCS, MIN_WORDS = 50, 10
#: The least distance between the quartiles that a band goes by; of pooled ones.
LEAST, LEAST_POOLED = 0.002, 0.05
#: Half the width of a band in distances between the quartiles: BAND, and SHORT over the root of the words, as short texts vary more.
#: Set by what labelled documents lose (README).
BAND, SHORT = 1.0, 12.0
# Fixed values of the base rules: white space between words, symbols.
SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
# Private marks before a text and after each word.
START, END = "\x02", "\x03"
#: Logarithms are summed as whole numbers of this unit, so in any order alike.
UNIT = 1e-6
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of all but its last character."""
    x = (h ^ (code + np.uint64(1))) * PRIME
    return x ^ (x >> np.uint64(29))


def hashes_of(grams: list[str], n: int) -> np.ndarray:
    """Hashes of n-grams of one length."""
    c = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(grams), n)
    h = np.zeros(len(grams), np.uint64)
    for k in range(n):
        h = mix(h, c[:, k])
    return h


def codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of START * (ORDER-1) + unit + END of all units, end to end; where predicted characters stand."""
    text = "".join([f"{START * (ORDER - 1)}{u}{END}" for u in units])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return c, np.flatnonzero(c != ord(START))


def owners(units: list[str], at: np.ndarray) -> np.ndarray:
    """Number of the unit that each position belongs to."""
    return np.repeat(np.arange(len(units)), [len(u) + ORDER for u in units])[at]


def window_hashes(c: np.ndarray, at: np.ndarray, n: int, end: int = 0) -> np.ndarray:
    """Hashes of the n characters up to ``end`` before each position."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        h = mix(h, c[at - k - end])
    return h


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each different hash, and the number of each hash among them."""
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def unit(words: list[bytes]) -> str:
    """A text for ``codes``: its words, lower-cased, with END between them."""
    text = b" ".join(words).decode("utf-8").lower().replace(START, "").replace(END, "")
    return text.replace(" ", END)


def gram_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram, n of all n-grams of ORDER characters; each task sends a gram once for each language."""

    def count(batches):
        forget()
        sums: dict = {}

        def emptied():
            for lang, grams in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(list(grams), pa.string()), "n": pa.array(list(grams.values()), pa.int64())})

        for batch in batches:
            for low, texts in text_runs(batch.column(1), RUN_CHARS):
                by_lang: dict = {}
                for lang, text in zip(batch.column(0).slice(low, len(texts)).to_pylist(), texts, strict=True):
                    if words := text.encode().split():
                        by_lang.setdefault(lang, []).append(unit(words))
                for lang, units in by_lang.items():
                    c, at = codes(units)
                    first, back = grouped(window_hashes(c, at, ORDER))
                    n = np.bincount(back).tolist()
                    to = sums.setdefault(lang, Counter())
                    for p, k in zip(at[first].tolist(), n, strict=True):
                        to["".join(map(chr, c[p - ORDER + 1 : p + 1].tolist()))] += k
                if sum(map(len, sums.values())) > 1_000_000:
                    yield from emptied()
                    sums = {}
        yield from emptied()

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """lang, size (n-gram length), gram, part (discounted share), for contexts: back (weight of the shorter context). Rows of one language and size are discounted alike."""
    out = None
    level = grams.select("lang", "gram", "n")
    for size in range(ORDER, 0, -1):
        level = written(level)
        counts = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(k: int, y: Column = y) -> Column:
            d = F.lit(float(k)) - (k + 1) * y * F.coalesce(F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.0))
            return F.least(F.greatest(d, F.lit(0.1)), F.lit(k - 0.05))

        d = counts.select(F.col("lang").alias("l"), discount(1).alias("d1"), discount(2).alias("d2"), discount(3).alias("d3"))
        context = F.substring("gram", 1, size - 1)
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(small(written(d)), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "gram", "n", context.alias("context"), less.alias("less"))  # a row for each language
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("less").alias("given"))
        t = totals.select(F.col("lang").alias("l"), F.col("context").alias("c"), "total", "given")
        parts = rows.join(t, F.col("lang").eqNullSafe(F.col("l")) & (F.col("context") == F.col("c"))).select("lang", F.lit(size).alias("size"), "gram", "n", ((F.col("n") - F.col("less")) / F.col("total")).alias("part"))
        backs = totals.select("lang", F.lit(-size).alias("size"), F.col("context").alias("gram"), F.col("total").alias("n"), (F.col("given") / F.col("total")).alias("part"))
        both = parts.unionByName(backs)
        out = both if out is None else out.unionByName(both)
        # the next order counts in how many contexts a shorter n-gram stands
        level = level.groupBy("lang", F.substring("gram", 2, size - 1).alias("gram")).agg(F.count("*").alias("n"))
    return written(out)


def gram_logs(model: DataFrame) -> DataFrame:
    """lang, h, n, log (log10 probability in UNITs) of every counted n-gram of ORDER characters; level by level, as each needs the next shorter one."""
    alphabet = model.where("size = 1").groupBy(F.col("lang").alias("pl")).agg((1.0 / (F.count("*") + 1)).alias("lower"))  # a row for each language
    shorter = None
    for size in range(1, ORDER + 1):
        rows = model.where(F.col("size") == size).select("lang", "gram", "n", "part")
        backs = model.where(F.col("size") == -size).select(F.col("lang").alias("bl"), F.col("gram").alias("bg"), F.col("part").alias("back"))
        rows = rows.join(backs, F.col("lang").eqNullSafe(F.col("bl")) & (F.substring("gram", 1, size - 1) == F.col("bg")))
        same = F.col("lang").eqNullSafe(F.col("pl"))
        rows = rows.join(small(written(alphabet)), same) if size == 1 else rows.join(shorter, same & (F.substring("gram", 2, size - 1) == F.col("pg")))
        rows = rows.select("lang", "gram", "n", (F.col("part") + F.col("back") * F.col("lower")).alias("p"))
        shorter = rows.select(F.col("lang").alias("pl"), F.col("gram").alias("pg"), F.col("p").alias("lower"))

    def hashed(batches):
        for batch in batches:
            h = hashes_of(batch.column(1).to_pylist(), ORDER)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), *batch.columns[2:]], names=["lang", "h", "n", "log"])

    log = F.round(F.log10("p") / UNIT).cast("long")
    return written(rows.select("lang", "gram", "n", log.alias("log")).mapInArrow(hashed, "lang string, h long, n long, log long"))


class Model:
    """The probabilities of one language, from all of its model at one place; what ``gram_logs`` is held against."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.parts, self.uniform = parts, 1.0 / alphabet

    def _find(self, size: int, h: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.parts.get(size, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(keys):
            return np.full(len(h), missing)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], missing)

    def log10(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and number of predicted characters of each unit."""
        c, at = codes(units)
        p = np.full(len(at), self.uniform)
        for size in range(1, ORDER + 1):
            p = self._find(size, window_hashes(c, at, size), 0.0) + self._find(-size, window_hashes(c, at, size - 1, 1), 1.0) * p
        owner = owners(units, at)
        return np.bincount(owner, np.log10(p), len(units)), np.bincount(owner, minlength=len(units))


def arrays_of(model: DataFrame) -> dict:
    """By language and size: sorted hashes and parts; for a model that fits in one place."""

    def hashed(batches):
        for batch in batches:
            size, grams = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object)
            h = np.zeros(len(size), np.uint64)
            for k in np.unique(size).tolist():
                h[size == k] = hashes_of(grams[size == k].tolist(), k if k > 0 else -k - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64)), batch.column(3)], names=["lang", "size", "h", "part"])

    rows = model.select("lang", "size", "gram", "part").mapInArrow(hashed, "lang string, size int, h long, part double").toArrow()
    size, h, part = [rows.column(c).to_numpy() for c in ("size", "h", "part")]
    code = rows.column("lang").combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    lang = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out: dict = {}
    for k, name in [*enumerate(code.dictionary.to_pylist()), (-1, None)]:
        for n in np.unique(size[lang == k]).tolist():
            mine = (lang == k) & (size == n)
            keys = h[mine].view(np.uint64)
            order = np.argsort(keys)
            out.setdefault(name, {})[n] = (keys[order], part[mine][order])
    return out


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated(words)


def repeated(words: list[bytes], window: int = 5) -> int:
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = mix(h, ids[k : n + k])
    key = np.unique(h, return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def common_logs(logs: DataFrame, max_grams: int) -> tuple[dict, bool]:
    """By language: sorted hashes and logs of the ``max_grams`` most frequent n-grams; whether there are others."""
    others = logs.count() > max_grams
    top = (logs.orderBy(F.desc("n"), "lang", "h").limit(max_grams) if others else logs).select("lang", "h", "log").toArrow()
    h, log = top.column("h").to_numpy().view(np.uint64), top.column("log").to_numpy()
    lang = np.array(top.column("lang").to_pylist(), object)
    out = {}
    for name in set(lang.tolist()):
        mine = np.flatnonzero(np.equal(lang, name))
        order = mine[np.argsort(h[mine])]
        out[name] = (h[order], log[order])
    return out, others


def score(df: DataFrame, logs: DataFrame, keep: list[str], lang_col: str, text_col: str, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The ``keep`` columns with SCORED; log_ppl (base 10) is null where there is nothing to score."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    common, others = common_logs(logs, max_grams)
    sent = df.sparkSession.sparkContext.broadcast(common)  # MAX_GRAMS n-grams at most
    sums = "__r long, __log long, __chars long, __g string, __h long, __m long"
    base = SCORED.removesuffix(", log_ppl double")
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *T.StructType.fromDDL(f"{base}, {sums}")])
    arrow, n, nothing = to_arrow_schema(schema), len(keep), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches):
        forget()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, texts in text_runs(batch.column(n + 1), RUN_CHARS):
                langs = batch.column(n).slice(low, len(texts)).to_pylist()
                lists = [t.encode().split() for t in texts]
                log, chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                rare = []
                for lang in set(langs):
                    mine = np.array([i for i, x in enumerate(langs) if x == lang and lists[i]], np.int64)
                    units = [unit(lists[i]) for i in mine]
                    c, at = codes(units)
                    owner = owners(units, at)
                    h = window_hashes(c, at, ORDER)
                    first, back = grouped(h)
                    keys, values = sent.value.get(lang, nothing)
                    place = np.minimum(np.searchsorted(keys, h[first]), max(len(keys) - 1, 0))
                    there = keys[place] == h[first] if len(keys) else np.zeros(len(first), bool)
                    value = np.where(there, values[place] if len(keys) else 0, 0)
                    chars[mine] = np.bincount(owner, minlength=len(mine))
                    log[mine] = np.rint(np.bincount(owner, value[back], len(mine))).astype(np.int64)  # whole numbers, so exact
                    left = np.flatnonzero(~there[back])
                    pair, m = np.unique(owner[left] * max(len(first), 1) + back[left], return_counts=True)
                    rare.append((row + mine[pair // max(len(first), 1)], [lang] * len(pair), h[first][pair % max(len(first), 1)].view(np.int64), m))
                kept = [batch.column(i).slice(low, len(texts)).cast(arrow.field(i).type) for i in range(n)]
                counts = [pa.array(x, pa.int64()) for x in zip(*map(base_counts, texts, lists), strict=True)]
                cols = [*kept, *counts, pa.array(row + np.arange(len(texts))), pa.array(log), pa.array(chars)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(texts), f.type) for f in list(arrow)[len(cols) :]]], schema=arrow)
                row += len(texts)
                for r, lang, h, m in rare:
                    if len(r):
                        gap = [pa.nulls(len(r), f.type) for f in arrow]
                        gap[n + 5], gap[n + 8], gap[n + 9], gap[n + 10] = pa.array(r), pa.array(lang, pa.string()), pa.array(h), pa.array(m.astype(np.int64))
                        yield pa.RecordBatch.from_arrays(gap, schema=arrow)

    both = df.select(*keep, F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
    out, log = both, F.col("__log")
    if others:  # what no worker holds is joined, exactly
        both = written(both)
        of = logs.select(F.col("lang").alias("__l2"), F.col("h").alias("__h2"), "log")
        rest = both.where("__h is not null").select("__r", "__g", "__h", "__m").join(of, F.col("__g").eqNullSafe(F.col("__l2")) & (F.col("__h") == F.col("__h2")))
        rest = rest.groupBy(F.col("__r").alias("__r2")).agg(F.sum(F.col("__m") * F.col("log")).alias("__more"))
        out = both.where("__h is null").join(rest, F.col("__r") == F.col("__r2"), "left")
        log = log + F.coalesce("__more", F.lit(0))
    ppl = F.when(F.col("__chars") > 0, -UNIT * log / F.col("__chars"))
    return out.select(*keep, *[x.split()[0] for x in base.split(", ")], ppl.alias("log_ppl"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text", band: float = BAND, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The ``keep`` columns of every row with SCORED, base_failed and kept."""
    logs = gram_logs(kneser_ney(gram_counts(df, lang_col, text_col)))
    rows = df.withColumn("__l", F.col(lang_col).cast("string"))
    scored = written(score(rows, logs, [*keep, "__l"], lang_col, text_col, max_grams))
    judged = (F.col("n_words") >= MIN_WORDS) & F.col("log_ppl").isNotNull()
    q = F.percentile(F.round("log_ppl", 4), [0.25, 0.75])  # exact, so the same for every partitioning; rounded values are few
    # a language with few documents has the quartiles of all, and room for more
    own, pooled = scored.where(judged).groupBy("__l").agg(q.alias("q"), F.count("*").alias("docs")), scored.where(judged).agg(q.alias("all"))
    few = F.col("docs") < MIN_DOCS
    bands = own.crossJoin(pooled).select(F.col("__l").alias("__b"), F.when(few, F.col("all")).otherwise(F.col("q")).alias("q"), F.when(few, LEAST_POOLED).otherwise(LEAST).alias("least"))  # one row beside each language's
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.col("least"))
    bands = written(bands.select("__b", F.col("q")[0].alias("__low"), F.col("q")[1].alias("__high"), wide.alias("__wide")))
    room = F.col("__wide") * (band + SHORT / F.sqrt(F.greatest("n_words", F.lit(1))))
    outside = judged & ((F.col("log_ppl") < F.col("__low") - room) | (F.col("log_ppl") > F.col("__high") + room))
    out = scored.join(small(bands), F.col("__l").eqNullSafe(F.col("__b")), "left")  # a row for each language
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).drop("__l", "__b", "__low", "__high", "__wide")


def keep_good(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept. The verdict follows from text and language alone, so rejected rows are found by their hashes."""
    name = uuid.uuid4().hex[:8]  # no column of the documents has these names
    t, i = f"t_{name}", f"i_{name}"
    of = F.to_json(F.struct(F.col(id_col).cast("string").alias("a"), F.col(lang_col).cast("string").alias("b")), {"ignoreNullFields": "false"})  # null and text stay apart
    marked = df.select("*", F.xxhash64(text_col).alias(t), F.md5(of).alias(i))
    rejected = written(judge(marked, [t, i], lang_col, text_col).where(~F.col("kept")).select(t, i).distinct())
    return marked.join(small(rejected), [t, i], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
