"""Components of near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from hourloom.llm import minhash

DOCS = "doc_id long, text string, k long, i long, label string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def roots(rows):
    """The least id of the component of each row, by all pairs; None is the least of none."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(sets[a]), least.get(root(a))) for a, (i, _) in enumerate(rows)]


def documents(seed, groups=10, size=16, words=(1, 150), edits=4):
    """Groups of copies with more and more edits, a passage that half of all share, and short texts."""
    r = random.Random(seed)
    passage = " ".join(f"shared{i}" for i in range(12))
    out = ["one two", "One  TWO", "three", "a b c", "a b c d", "", " \n", None, "日本 語 テキスト", "x " * 30, "x " * 31]
    for g in range(groups):
        base = [f"v{r.randrange(60 if g % 2 else 5000)}" for _ in range(r.randint(*words))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["new"], [f"v{r.randrange(5000)}", "more"]]) or ["v"]
            out.append(" ".join(copy) + (f" {passage}" if r.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize("long, tile, frequent", [(64, 500_000, 64), (2, 300, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, long, tile, frequent):
    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "TILE_TOKENS", tile)
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    r = random.Random(long)
    texts = documents(long)
    rows = list(zip(r.sample(range(10**6), len(texts)), texts, strict=True))
    rows += [rows[20], rows[20], (None, rows[30][1]), (None, "only a null id has this text"), (rows[40][0], "another text of the same id"), (5, " ".join(f"w{i}" for i in range(30_000))), (6, " ".join(f"w{i}" for i in range(100, 30_000)))]
    docs = spark.createDataFrame([(*x, 1, 2, "clash") for x in rows], DOCS).repartition(3)
    out = minhash.report(docs).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in out) == sorted(map(str, roots(rows)))
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Lists of 400 nodes, of which many are linked with a few others only."""
    monkeypatch.setattr(minhash, "TILE_TOKENS", 8_000)
    texts = documents(31, groups=1, size=400, words=(70, 70), edits=6)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.report(docs).collect()}
    expected = {i: c for i, _, c in roots(rows)}
    assert got == expected and 20 < len(set(expected.values())) < 400


def test_text_ids_and_one_of_each_component(spark):
    texts = documents(7, groups=6, size=6)
    rows = [(f"d{(i * 37) % 101:03d}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1.5) for x in rows], "key string, body string, component double")
    expected = {i: c for i, _, c in roots(rows)}
    got = {x.doc_id: x.component_id for x in minhash.link(docs, "key", "body").collect()}
    assert got == expected
    left = minhash.keep_one(docs, "key", "body")
    assert left.columns == docs.columns and {x.key for x in left.collect()} == {i for i, c in expected.items() if i == c}


def test_empty_tables(spark):
    assert minhash.report(spark.createDataFrame([], DOCS)).count() == 0
    none = minhash.report(spark.createDataFrame([(1, None, 0, 0, ""), (2, " ", 0, 0, "")], DOCS)).orderBy("doc_id").collect()
    assert [tuple(x) for x in none] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_what_sketches_of_a_union_share():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = [np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64)) for _ in range(2)]
        rows = [minhash.matrix(np.zeros(min(len(x), minhash.KEPT), np.int64), x[: minhash.KEPT], 1) for x in (a, b)]
        some, every = minhash.shared_of_union(*rows)
        sketches = [set(x[: minhash.KEPT].tolist()) for x in (a, b)]
        union = sorted(sketches[0] | sketches[1])[: minhash.KEPT]
        assert some[0] == len(set(union) & sketches[0] & sketches[1]) and every[0] == len(sketches[0] & sketches[1])


def test_odds_of_losing_a_link():
    """Sets of similarity 0.85: the least that their sketches share in 20,000 draws is far above what is asked for."""
    r = np.random.default_rng(5)
    both = r.binomial(minhash.KEPT, 0.85, 20_000).min(), r.binomial(minhash.LISTED, 0.85, 20_000).min()
    assert both[0] > minhash.LEAST_SHARED + 4 and both[1] > minhash.AGREE + 2
