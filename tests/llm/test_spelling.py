"""Words, near words, forms and roots against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from hourloom.llm import spelling
from hourloom.llm.common import LOWER, UPPER

DOCS = "doc_id long, text string, word string, n long, key string"


def plain_words(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    out, form = {}, {}
    for w in n:
        close = [v for v in n if one_apart(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(close)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def test_forms_and_roots_are_brute_force(spark):
    r, base = random.Random(5), ["abababab", "aaaaaaaa", "grounded", "Éclairées", "straße\xdf\xff", "withdrawal", "ZÀÇÊËÏÖØ"]
    pool = []
    for w in base:
        last = w
        for step, times in enumerate((4000, 300, 25, 2)):  # chains of forms
            pool += [last] * times
            for _ in range(6):  # other near words
                at = r.randrange(len(last))
                pool += [last[:at] + r.choice(["", "x", last[at] + "q"]) + last[at + 1 :]] * r.choice([1, 2, 3, 30])
            at = r.randrange(1, len(last))
            last = last[:at] + "klmnop"[step] + last[at:]
    r.shuffle(pool)
    rows = [(i if i % 50 else None, r.choice([" ", "\n", "1", ", "]).join(pool[k : k + 40]), "clash", 1, "k") for i, k in enumerate(range(0, len(pool), 40))]
    rows += [(1, None, "c", 1, "k"), (2, "", "c", 1, "k"), rows[3], (9, "q" * 40_000 + " " + "q" * 39_999 + " ", "c", 1, "k"), (10, "q" * 40_000 + " " + "q" * 39_999, "c", 1, "k")]
    expected = plain([x for x in rows if "qqqq" not in (x[1] or "")])
    got = {tuple(x) for x in spelling.group(spark.createDataFrame(rows, DOCS)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    long = {x for x in got if len(x[0]) > 1000}
    assert got - long == expected and {len(x[0]) for x in long} <= {39_999, 40_000} and long
    assert any(x[1] and x[2] != x[1] for x in got)  # a chain


def test_deletion_keys_are_those_of_the_words_left():
    r = random.Random(6)
    texts = ["".join(r.choice("abÀÿ") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["", "zzzzzz", "\U0001f600a"]
    owner, key = spelling.deletion_keys(texts)
    every = sorted({t[:i] + t[i + 1 :] for t in texts for i in range(len(t))} | set(texts))
    own = dict(zip(every, spelling.deletion_keys(every)[1][: len(every)].tolist(), strict=True))
    found = defaultdict(list)
    for o, k in zip(owner.tolist(), key.tolist(), strict=True):
        found[o].append(k)
    for i, t in enumerate(texts):
        assert sorted(found[i]) == sorted(own[x] for x in [t, *{t[:j] + t[j + 1 :] for j in range(len(t))}])
    assert len(set(own.values())) == len(every) and np.array(key).dtype == np.int64


def test_nothing_to_group(spark):
    assert spelling.group(spark.createDataFrame([], DOCS)).count() == 0
    one = spelling.group(spark.createDataFrame([(1, "nothing repeated anywhere", "", 1, ""), (2, None, "", 1, "")], DOCS))
    assert one.count() == 0
    twice = spelling.group(spark.createDataFrame([(1, "REPEATED repeated", "", 1, "")], DOCS)).collect()
    assert [tuple(x) for x in twice] == [("repeated", None, "repeated", 2, 0, None)]
