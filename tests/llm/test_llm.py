"""The operators against brute force, the public libraries and hand-made edge cases."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import byte_bpe, common, decontaminate, language_id, line_dedup, lm, ngram_join, pii, quality, queries, setjoin, token_counts, token_files, tokens
from hourloom.llm.common import shared_dir

os.environ["TOKENIZERS_PARALLELISM"] = "false"
D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", "   ", "a  b \n c", "\n\n x", " lead", "trail ", "日本語テキスト über naïve", "a" * 5000, "<|endoftext|> x", "x<|endoftext|>y <|startoftext|>", "\x1c a\x1f b", "é ́x", "\xa0a \xa0 b", "İSTANBUL ΑΣ. ΣΑΣ",
    "12345 67 890", "don't I'll x's", "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelve", "word " * 20_000,
]


def odd_docs(spark, extra=()):
    rows = [(i, t, None if i % 5 == 0 else "en", None, None) for i, t in enumerate([*ODD, *extra])]
    return spark.createDataFrame([*rows, (None, "a null id", "en", "s", 1), (3, ODD[3], "en", "s", 1)], DOCS)


def mixed(n, seed, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


def put(spark, tmp_path, docs, items=()):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if not q.startswith(("op11_", "op13_"))))  # those two give no row a document: their own tests
def test_empty_and_odd_tables(spark, tmp_path, name):
    d = put(spark, tmp_path / "empty", spark.createDataFrame([], DOCS))
    assert queries.QUERIES[name](spark, d).count() == 0
    rows = odd_docs(spark).withColumn("k", F.lit(1)).withColumn("t", F.lit("clash"))
    d = put(spark, tmp_path / "odd", rows, [(1, ODD[17]), (2, None), (3, "")])
    out = queries.QUERIES[name](spark, d)
    assert out.count() == rows.count() and "doc_id" in out.columns


def test_bpe_is_the_librarys_and_round_trips(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = byte_bpe.PieceEncoder(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.bpe.ranks, special_tokens={})
    texts = [t or "" for t in ODD] + mixed(500, 1, "ab c\nétxyz'. 1日́<|>") + mixed(300, 2, ["in", "er", "the", "s", "tion", "on", "a", " "])
    got = encoder(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [encoder.bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in got] == [t.encode() for t in texts]


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [t or "" for t in ODD] + mixed(500, 3, "ab c\nétxyz'. 1日́<|>\xa0") + mixed(300, 4, "aAbB<|endoftext|>")
    sizes, counts = token_counts.TokenCounter(path)(texts)
    assert counts == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes == [len(t.encode()) for t in texts]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = odd_docs(spark, mixed(200, 5, "ab c\nétx'. 1日<|endoftext|>"))
    manifest = token_files.write_tokens(docs, shared_dir(spark), P.path("byte_bpe_50k.json"), 2, files=3)
    rows = token_files.read_tokens(manifest).collect()
    expected = sorted([(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()])
    start, found = 0, {(r.doc_id, r.start): r for r in rows}
    for doc_id, text in expected:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        r = found[None if doc_id < 0 else doc_id, start]
        assert bytes(r.ids) == ids.tobytes()
        start += len(ids)
    some = token_files.read_documents(manifest, [7, 21])
    assert set(some) == {7, 21} and some[7][-1] == 2


def test_full_memory_keeps_what_the_texts_have():
    asked, memo = [], {}

    def after_space(words):
        asked.extend(words)
        return [w.upper() for w in words]

    for texts, want in ((["a b c d"], [[" A", "B", "C", "D"]]), (["x b c e f"], [[" X", "B", "C", "E", "F"]])):
        out = tokens.encode_pieces(texts, memo, after_space, lambda ts: [f" {t.upper()}" for t in ts], limit=6)
        assert out == want and len(memo) <= 6
    assert sorted(asked) == ["b", "c", "d", "e", "f"]  # b and c once


def test_pieces_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    memo = Counted({" a": 1, "b": 2, "c": 3})
    assert tokens.encode_pieces(["a b c b", "a c"], memo, lambda ws: [], lambda ts: []) == [[1, 2, 3, 2], [1, 3]]
    assert Counted.asked == 6
    long = "y" * 100
    out = tokens.encode_pieces([f"a z. {long} z. b"], memo, lambda ws: [f"<{w}>" for w in ws], lambda ts: [f"[{t}]" for t in ts])
    assert out == [[1, "<z>[.]", f"<{long}>", "<z>[.]", 2]] and long not in memo and set(memo) == {" a", "b", "c", "z", "z."}


def test_workers_get_bounded_batches(spark, tmp_path):
    docs = common.written(spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")))
    size = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"m": [b.nbytes]}) for b in batches), "m long")
    sizes = [r.m for r in size.collect()]
    assert sum(sizes) >= 30_000_000 and max(sizes) <= common.BATCH_BYTES + 20_000
    spark.conf.set(common.BATCH_SETTING, "1m")
    try:
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) in ("1m", "1048576b")  # a lower bound of the session stays
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_tokens_are_counted_in_little_memory():
    r = np.random.default_rng(3)
    held = [r.integers(0, 200_000, 100_000).astype(np.uint64) for _ in range(10)]
    t, c = np.unique(np.concatenate(held), return_counts=True)
    tracemalloc.start()
    got = setjoin.counted_tokens(held, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].tolist() == t[c >= 4].tolist() and got[1].tolist() == c[c >= 4].tolist() and not held
    assert peak < 2 * 8_000_000
    assert [len(x) for x in setjoin.counted_tokens([np.zeros(0, np.uint64)], 1)] == [0, 0]


def test_reader_unpacks_only_what_is_asked_and_checks(tmp_path):
    path = str(tmp_path / "x.tok")
    with pa.OSFile(path, "wb") as sink:
        writer = token_files.TokenWriter(sink)
        for i in range(6):
            writer.add(i, np.full(40_000, i, "<u4").tobytes())
        writer.close()
    fs, name = token_files.open_fs(path)
    reader = token_files.TokenReader(fs.open_input_file(name))
    asked = []
    plain, reader.frame = reader.frame, lambda k: asked.append(k) or plain(k)
    assert [np.frombuffer(x, "<u4")[0] for _, x in reader.documents([3])] == [3] and len(asked) == 1 < len(reader.plain)
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  either the frame or its checksum
        list(token_files.TokenReader(fs.open_input_file(name)).documents())


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii_is_brute_force(spark):
    texts = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 255.256.1.1", "x" * 50_000, "1 " * 20_000 + "2", "+1 (988) 555-2485 é😀 +12345678", "4041894974608795 4041-8949-7460-8795"]
    texts += mixed(800, 6, "a1.@+- _%😀é2(") + mixed(800, 7, ["4041894974608795", " ", "-", "1", "a@b.c", "+1", "9.9.9.9", "."])
    docs = odd_docs(spark, texts)
    for r, t in zip(pii.report(docs).collect(), [x.text or "" for x in docs.collect()], strict=True):
        spans = [[m.span() for m in re.finditer(p, t) if valid(k, m.group())] for k, p in PII.items()]
        text = ",".join(f"{k}:{a}:{b}" for k, s in zip(PII, spans, strict=True) for a, b in s)
        assert [len(s) for s in spans] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    more = pii.report(spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00"), (2, "DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"), (4, "no 123-45-6789")], "doc_id long, text string"))
    assert [r.spans for r in more.orderBy("doc_id").collect()] == ["iban:5:32", "", "ssn:4:15", ""]


def test_decontamination_is_brute_force():
    r = random.Random(8)
    for _ in range(300):
        items = [[bytes([97 + r.randrange(3)]) for _ in range(r.randrange(0, 9))] for _ in range(4)]
        items = [x for x in items if x]
        doc = [bytes([97 + r.randrange(3)]) for _ in range(30)]
        hit, named = set(), set()
        for k, item in enumerate(items):
            n = min(5, len(item))
            for i in range(len(item) - n + 1):
                for j in range(len(doc) - n + 1):
                    if doc[j : j + n] == item[i : i + n]:
                        hit.update(range(j, j + n))
                        named.add(k)
        spans, found = decontaminate.Matcher(*decontaminate.matcher_parts(items, 5)).hits(doc)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == named


def test_decontamination_in_shards_and_cutting(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"Clean words here. {passage} and after that " + "more of it " * 20), (2, passage), (3, "nothing"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage.upper()), (2, "a short item"), (3, passage)], "item_id long, text string")
    one, many = [sorted(map(repr, decontaminate.find_hits(docs, items, shard_words=n).collect())) for n in (10**6, 5)]
    assert one == many
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(left) == {1, 3, 4} and left[1].startswith("Clean words here. and after") and left[3] == "nothing"
    assert left == {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, shard_words=5).collect()}


def test_cutting_goes_on_until_nothing_is_hit_and_leaves_other_columns(spark):
    """Passages nested four deep: each cut brings the next together; columns with the names of results stay as they are."""
    item = [f"w{i}" for i in range(12)]
    nested = list(item)
    for _ in range(4):
        nested = [*item[:6], *nested, *item[6:]]
    text = " ".join(["clean"] * 200 + nested + ["tail"] * 200)
    rows = [(1, text, 7, ["mine"], "s"), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, items array<string>, spans string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got[1].text.split() == ["clean"] * 200 + ["tail"] * 200 and (got[1].n_words, got[1]["items"], got[1].spans) == (7, ["mine"], "s") and got[2].text is None


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed, groups=12, size=14):
    r, out = random.Random(seed), []
    for _ in range(groups):
        words = [f"v{r.randrange(400)}" for _ in range(r.randrange(6, 120))]
        for _ in range(size):
            copy = list(words)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(400)}"
            out.append(" ".join(copy))
    return out + ["one two", "one two", "Three", "", "x y z w"]


def test_ngram_join_is_brute_force(spark):
    texts = near_copies(9)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    left = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert left == {i for i, s in sets.items() if root(i) == i}


@pytest.mark.parametrize("n", [100, 3000])
def test_whole_sets_are_made_only_for_pairs_that_bits_leave_open(spark, monkeypatch, n):
    r, made, sets_of = random.Random(5), [], ngram_join.sets_of
    opening = [f"w{r.randrange(3000)}" for _ in range(2 * n)]
    texts = [opening + [f"w{r.randrange(3000)}" for _ in range(3 * n)] for _ in range(20)]  # they share prefixes, but are far from linked
    rows = [(i, " ".join(x), None, None, None) for i, x in enumerate([*texts, [*texts[0], "more"]])]

    def spy(*args):
        out = sets_of(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "sets_of", spy)
    got = {x.doc_id: x.component_id for x in ngram_join.link(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i % 20 for i in range(21)}
    assert sum(made) == 2


def test_marks_are_bitmaps_and_odd_bits(monkeypatch):
    monkeypatch.setattr(ngram_join, "MARKED", 3)
    s = setjoin.Sets(ngram_join.shingle_units, ["", *mixed(10, 7, "ab "), " ".join(map(str, range(700))), "one"])
    bits, odd = ngram_join.marks(s)
    for i, n in enumerate(s.size.tolist()):
        tokens = s.token[s.start[i] : s.start[i] + n]
        assert bits[i].as_py() == ngram_join.bitmap(tokens.view(np.int64)).tobytes()
        width = max(64, 1 << max(n - 1, 0).bit_length())
        count = Counter(int(t) % width for t in setjoin.mix(tokens))
        assert odd[i].as_py() == sum((c & 1) << b for b, c in count.items()).to_bytes(width // 8, "little")
    for i, j in ((0, 1), (1, 11), (11, 1), (11, 11)):
        apart = len({*s.token[s.start[i] : s.start[i] + s.size[i]].tolist()} ^ {*s.token[s.start[j] : s.start[j] + s.size[j]].tolist()})
        found = int(ngram_join.odd_apart(odd.take([i]), odd.take([j]))[0])
        assert found <= apart and (apart - found) % 2 == 0 and (found > 0) == (apart > 0)
    assert all(len(x) == 0 for x in ngram_join.marks(setjoin.Sets(ngram_join.shingle_units, [])))


def test_trees_give_no_pair_that_odd_bits_exclude(spark):
    r = random.Random(8)
    common = [f"c{i}" for i in range(600)]
    texts = [" ".join([*common, *[f"w{r.randrange(10**6)}" for _ in range(600)]]) for _ in range(30)]  # bitmaps alone leave all pairs open
    texts += [" ".join([*texts[0].split()[:-5], f"x{i}"]) for i in range(3)]
    s = setjoin.Sets(ngram_join.shingle_units, texts)
    bits, odd = [x.to_pylist() for x in ngram_join.marks(s)]
    rows = [(t, int(s.node[i]), int(s.size[i]), i, bits[i], odd[i]) for t in (1, 2) for i in range(len(texts))]
    members = spark.createDataFrame(rows, "t long, k long, n int, label long, bits binary, odd binary")
    got = {frozenset((x.a, x.b)) for x in ngram_join.tree_pairs(members).collect()}
    assert got == {frozenset((int(s.node[i]), int(s.node[j]))) for i in (0, 30, 31, 32) for j in (0, 30, 31, 32) if i != j}


def test_signature_trees_lose_no_pair():
    r = np.random.default_rng(1)
    base = [r.choice(3000, 200, replace=False) for _ in range(8)]
    sets = [np.unique(np.where(r.random(200) < 0.05, r.integers(0, 3000, 200), base[i % 8])) for i in range(120)]
    size, bits = np.array([len(s) for s in sets]), np.stack([ngram_join.bitmap(s) for s in sets])
    label = np.arange(120)
    tree = ngram_join.SignatureTree(size, bits, label)
    a, b = ngram_join.walk(tree, tree, True)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    true = {frozenset((i, j)) for i in range(120) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (size[i] + size[j] - n)}
    assert true and true <= found and len(found) < 120 * 119 / 2
    x, y = ngram_join.SignatureTree(size[:50], bits[:50], label[:50]), ngram_join.SignatureTree(size[50:], bits[50:], label[50:])
    a, b = ngram_join.walk(x, y, False)
    assert {p for p in true if min(p) < 50 <= max(p)} <= {frozenset((i, j + 50)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}


def test_line_dedup_is_brute_force(spark):
    r = random.Random(10)
    lines = near_copies(11, groups=10, size=8)
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    gone, before = defaultdict(list), []
    for row in docs.orderBy("doc_id").collect():
        for k, line in enumerate(row.text.split("\n") if row.text is not None else ()):
            s = set(line.encode().lower().split())
            if s:
                if any(100 * len(s & x) >= 80 * len(s | x) for x in before):
                    gone[row.doc_id].append(k)
                before.append(s)
    got = {x.doc_id: x.removed for x in line_dedup.report(docs).collect()}
    assert got == {i: ",".join(map(str, gone[i])) for i in got}
    kept = {x.doc_id: x.text for x in line_dedup.dedup(docs).collect()}
    for i, t in enumerate(texts):
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
        assert kept.get(i, "") == "\n".join(left)


def test_short_lines_go_too(spark, tmp_path):
    r = random.Random(12)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 8))) for _ in range(120)] + ["x y z w " * 15, "w z y x"]
    rows = [(i, t, "en", None, None) for i, t in enumerate(lines)]
    sets = [set(t.split()) for t in lines]
    expected = {i for i, s in enumerate(sets) if s and any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i])}
    got = queries.op10_line_dedup(spark, put(spark, tmp_path, spark.createDataFrame(rows, DOCS))).where("n_removed > 0").collect()
    assert {x.doc_id for x in got} == expected and any(len(sets[i]) == 1 for i in expected)


def test_line_dedup_in_tiles_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 40)
    r = random.Random(11)
    base = [f"common{i}" for i in range(24)]
    lines = []
    for i in range(400):  # one large block: variants with up to five words of their own, some of them copies
        words = list(base)
        for at in r.sample(range(24), r.randint(0, 5)):
            words[at] = f"own{r.randint(0, 60)}"
        lines.append((i, " ".join(words)))
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    sets = [set(t.split()) for _, t in lines]
    expected = {i for i, s in enumerate(sets) if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i])}
    gone = line_dedup.removed_lines(docs)
    assert {x.doc_id for x in gone.collect()} == expected and 0 < len(expected) < 400


@pytest.mark.parametrize("kind, many", [("text ids", 32), ("unsorted", 32), ("unsorted", 1)])
def test_line_dedup_with_ids_out_of_file_order_is_brute_force(spark, monkeypatch, kind, many):
    """Groups of 46 lines, so lines have more partners than MANY; ids are texts, or numbers that are not in file order, some rows come twice."""
    monkeypatch.setattr(line_dedup, "MANY", many)
    r, lines = random.Random(21), []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(24)]
        for _ in range(46):
            copy = list(words)
            for at in r.sample(range(24), r.randint(0, 2)):
                copy[at] = f"own{r.randrange(10**6)}"
            r.shuffle(copy)
            lines.append(" ".join(copy))
    r.shuffle(lines)
    if kind == "text ids":
        ids = [f"d{r.randrange(10**9):09d}" for _ in range(0, len(lines), 2)]
        rows, order = [(i, "\n".join(lines[2 * k : 2 * k + 2])) for k, i in enumerate(ids)], "doc_id string, text string"
    else:
        rows, order = list(zip(r.sample(range(10**6), len(lines)), lines, strict=True)), "doc_id long, text string"
        rows += rows[:12]
        r.shuffle(rows)
    expected, before = set(), []
    for i, text in sorted(set(rows)):
        for k, line in enumerate(text.split("\n")):
            s = set(line.split())
            if any(100 * len(s & x) >= 80 * len(s | x) for x in before):
                expected.add((i, k))
            before.append(s)
    got = {(x.doc_id, x.line) for x in line_dedup.removed_lines(spark.createDataFrame(rows, order).coalesce(1)).collect()}
    assert got == expected and len(expected) > 500


def test_words_and_sets_are_pythons():
    from hourloom.llm import setjoin

    texts = ["", " ", "A b\tc\x0bA", "ü Ünï x" + "y" * 300, "abcdefgh abcdefghi abcdefghij", "x" * 700 + " z", *mixed(200, 3, "abAB \n\x1cé")]
    h, sizes = setjoin.word_hashes(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert sizes.tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert [len(x) for x in setjoin.word_hashes([])] == [0, 0]
    for units in (line_dedup.line_units, ngram_join.shingle_units):
        s = setjoin.Sets(units, texts)
        assert all((np.diff(s.token[a : a + n].astype(object)) > 0).all() for a, n in zip(s.start.tolist(), s.size.tolist(), strict=True))
        keys = np.unique(s.token)[::2]
        rank = dict(zip(keys.tolist(), (np.arange(len(keys)) + 1).tolist(), strict=True))
        unit, token, place, parts = s.prefix((keys, np.arange(len(keys)) + 1, np.full(len(keys), 3)))
        for u in range(len(s.size)):
            own = sorted(s.token[s.start[u] : s.start[u] + s.size[u]].tolist(), key=lambda x: (rank.get(x, 0), x))
            n = len(own) - -(-80 * len(own) // 100) + 1 if own else 0
            assert token[unit == u].tolist() == own[:n] and place[unit == u].tolist() == list(range(n))
            assert parts[unit == u].tolist() == [3 if x in rank else 1 for x in own[:n]]
        odd = s.parities()
        assert all(odd[u] == np.bitwise_xor.reduce([np.uint64(0), *(np.uint64(1) << (setjoin.mix(s.token[s.start[u] : s.start[u] + s.size[u]]) >> np.uint64(58)))]) for u in range(len(s.size)))


@pytest.mark.parametrize("small, held, part_rows, frequent", [(2, 4, 4096, 10**9), (3, 6, 2, 4)])
def test_every_way_of_comparing_a_block_finds_all_links(spark, monkeypatch, small, held, part_rows, frequent):
    """Blocks side by side, held, too large to hold, and cut in parts give the same rows."""
    from hourloom.llm import setjoin

    for name, value in (("SMALL", small), ("HELD", held), ("PART_ROWS", part_rows), ("FREQUENT", frequent), ("COUNT_LEAST", 1)):
        monkeypatch.setattr(setjoin, name, value)
    monkeypatch.setattr(line_dedup, "TILE", 5)
    monkeypatch.setattr(line_dedup, "MANY", 3)
    monkeypatch.setattr(ngram_join, "TILE", 5)
    test_ngram_join_is_brute_force(spark)
    test_line_dedup_is_brute_force(spark)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = language_id.evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.evaluate(odd_docs(spark)).where("doc_id in (0, 1, 2, 15)").collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def grams_in_order(text, size):
    """The most frequent n-grams of the runs of letters, with a pad on either side; ties by the n-gram."""
    n = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f"_{word}_"
        n.update(word)
        n.update(padded[i : i + 2] for i in range(len(padded) - 1))
        n.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(n, key=lambda g: (-n[g], g))[:size], n


def test_out_of_place_distances_are_brute_force(spark):
    r = random.Random(2)
    words = {"x": ["ab", "abc", "baa", "é"], "y": ["cd", "dce", "ab", "ü"], "z": ["zz", "z", "éz"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randrange(0, 30))) + r.choice(["", ".", " 1"]), k) for i, k in enumerate(r.choice("xyz") for _ in range(120))]
    rows += [(200, None, "x"), (201, "12 .", "y"), (202, "ab abc", None), (203, "ab abc", None), (203, "ab abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 9
    profiles = language_id.learn(df, size)
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None:
            counts[lang].update(grams_in_order(text or "", size)[1])
    assert profiles == {k: sorted(n, key=lambda g: (-n[g], g))[:size] for k, n in sorted(counts.items())}
    for got in language_id.identify(df, profiles, ["doc_id", "text"], size).collect():
        own = grams_in_order(got.text or "", size)[0]
        away = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(away, key=lambda k: (away[k], k))
        assert (got.lang_pred, round(got.score, 12)) == ((best, round(1 - away[best] / (size * len(own)), 12)) if own else ("und", 0.0))


def test_base_counts_are_brute_force():
    for text in ["", " \n", "\n\n", *mixed(400, 12, "ab \n\t#|é"), *mixed(100, 13, ["a b c d e ", "x ", "\n", "$"])]:
        words = text.encode().split()
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
        lines = text.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.strip(quality.SPACES) and x in lines[:i])
        assert quality.base_counts(text, words) == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated))


def test_quality_base_counts(spark):
    text = "a b c d e a b c d e z\n\n#x $1\n#x $1\n  \n"
    words = text.encode().split()
    assert quality.base_counts(text, words) == (15, 19, 4, 1, 10)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for r in quality.judge(docs, ["doc_id", "text"]).collect():
        w = r.text.encode().split()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).count() == quality.judge(docs, ["doc_id"]).where("kept").count()


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "abab abba baab aab bba abc", "x")], "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.gram_counts(docs, "lang", "text"))
    parts = quality.arrays_of(model)["x"]
    m = quality.Model(parts, len(parts[1][0]) + 1)
    total = 0.0
    for c in "abc\x03":  # what may follow a at the start of a word
        codes, at = quality.codes(["a"]) if c == "\x03" else quality.codes(["a" + c])
        p = np.full(len(at), m.uniform)
        for n in range(1, quality.ORDER + 1):
            p = m._find(n, quality.window_hashes(codes, at, n), 0.0) + m._find(-n, quality.window_hashes(codes, at, n - 1, 1), 1.0) * p
        total += p[1]
    assert abs(total + m.uniform * np.prod([m._find(-n, quality.window_hashes(codes, at, n - 1, 1), 1.0)[1] for n in range(1, quality.ORDER + 1)]) - 1) < 1e-6


def test_rare_ngrams_count_beyond_what_workers_hold(spark):
    r = random.Random(12)
    texts = [(i, " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(30)), [None, "x", "y"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame([*texts, (99, "", "x"), (100, None, None)], "doc_id long, text string, lang string")
    whole, few = [{x.doc_id: x for x in quality.judge(docs, ["doc_id"], max_grams=k).collect()} for k in (10**6, 5)]
    assert whole == few and whole[99].log_ppl is None
    models = quality.arrays_of(quality.kneser_ney(quality.gram_counts(docs, "lang", "text")))
    for i, t, lang in texts:
        p, n = quality.Model(models[lang], len(models[lang][1][0]) + 1).log10([quality.unit(t.encode().split())])
        assert abs(whole[i].log_ppl + p[0] / n[0]) < 2e-6


def test_word_order_and_separators_count(spark):
    r = random.Random(13)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    texts = [words[k : k + 100] for k in (r.randrange(200) for _ in range(120))]
    planted = ["\n".join(reversed(texts[0])), " | ".join(texts[0]), " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(100))]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)] + [(1000 + i, t, "x") for i, t in enumerate(planted)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert got[1000].log_ppl > got[0].log_ppl + 0.01  # the same words in another order
    assert not any(got[i].kept for i in (1000, 1001, 1002)) and sum(got[i].kept for i in range(120)) >= 114


def test_lm_base_is_exact_and_windows_score_once(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, D).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t.encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in rows:
        w = t.encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        g = got[i]
        assert abs(g.base_score - base) < 1e-6 * abs(base) and (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n) and g.score < 0
    sizes = np.array([1, 63, 64, 65, 120, 121, 500])
    low, text, first = lm.windows(sizes)
    for k, size in enumerate(sizes.tolist()):
        scored = [p for a, f in zip(low[text == k].tolist(), first[text == k].tolist(), strict=True) for p in range(max(a, f), min(a + lm.LENGTH, size))]
        assert scored == list(range(size))


def some_tables(rng, size=200):
    n = np.append(rng.integers(1, 50, size - 1), 20)
    after = rng.integers(0, 9, (lm.BUCKETS, size))
    tables = lm.classes(n, after) | {"bucket": lm.buckets(n)}
    prior = rng.normal(0, 1, (lm.INPUTS, lm.CLASSES)).astype(np.float32)
    return tables | {"prior": prior}


def test_every_id_of_a_training_text_takes_part():
    rng = np.random.default_rng(3)
    tables = some_tables(rng)
    ids = rng.integers(0, 60, 600)
    texts = [np.append(ids, 199).astype("<u2")]
    for at in range(0, 600, 50):
        other = ids.copy()
        other[at] = 61
        texts.append(np.append(other, 199).astype("<u2"))
    plain, *others = [lm.trained(lm.Attention.start(), tables, [t.tobytes()], "<u2")[0] for t in texts]
    assert all(np.abs(x - plain).max() > 1e-6 for x in others)


def test_windows_in_batches_score_as_one_window_at_a_time():
    """Brute force: each id from its own window alone, by a plain softmax; probabilities of a next id sum to one."""
    rng = np.random.default_rng(4)
    tables = some_tables(rng)
    params = lm.Attention.start() + rng.normal(0, 0.2, len(lm.Attention.start())).astype(np.float32)
    texts = [np.append(rng.integers(0, 199, n), 199) for n in (0, 1, 5, 63, 64, 65, 150, 400)]
    sizes = np.array([len(t) for t in texts])
    got = lm.Scorer(params, tables)(np.concatenate(texts), sizes)
    p = {k: v.astype(float) for k, v in lm.Attention(params, tables["prior"]).p.items()}

    def distribution(window, first):
        """Of the id after ``window`` (ids before it, from where its window starts)."""
        z = [lm.Attention.START if first else tables["kind"][window[0]], *tables["kind"][window[1:]]]
        x = p["E"][z]
        s = (x[-1] @ p["Q"]) @ (x @ p["K"]).T / np.sqrt(lm.WIDTH) + p["R"][np.arange(len(z))[::-1]]
        a = np.exp(s - s.max())
        logits = (a / a.sum()) @ x @ p["O"] + p["b"] + tables["prior"][tables["kind"][window[-1]]]
        c = np.exp(logits - logits.max())
        return (c / c.sum())[tables["cls"]] * np.exp(tables["share"][:, tables["bucket"][window[-1]]].astype(float))

    for t, size, score in zip(texts, sizes.tolist(), got.tolist(), strict=True):
        total = 0.0
        low, _, first = lm.windows(np.array([size]))
        for a, f in zip(low.tolist(), first.tolist(), strict=True):
            for at in range(f, min(a + lm.LENGTH, size)):
                before = [199, *t.tolist()][a : at + 1]
                q = distribution(np.array(before), a == 0)
                total += np.log10(q[t[at]])
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def test_lm_is_the_same_for_any_partitioning(spark, monkeypatch):
    """Shards are trained apart here."""
    monkeypatch.setattr(lm, "SHARD_IDS", 30_000)
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    make = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    one, many = [{r.doc_id: r.score for r in lm.score(docs.repartition(n), *make, lm.held_out("doc_id")).collect()} for n in (1, 5)]
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-4 * abs(one[i]) for i in one)


def test_attention_gradients_and_causality():
    rng = np.random.default_rng(0)
    model = lm.Attention(lm.Attention.start() + rng.normal(0, 0.1, len(lm.Attention.start())), rng.normal(0, 1, (lm.INPUTS, lm.CLASSES)))
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    z, y = rng.integers(0, 50, (2, 6)), rng.integers(0, 20, (2, 6))
    valid = np.ones((2, 6), bool)
    grads = model.gradients(z, z, y, valid)
    for name in ("E", "Q", "K", "R", "O", "b"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        loss = []
        for step in (1e-5, -2e-5):
            model.p[name][at] += step
            loss.append(-model.log_prob(z, z, y).mean())
        model.p[name][at] += 1e-5
        assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))
    other = z.copy()
    other[:, 4:] = 7
    assert np.allclose(model.log_prob(z, z, y)[:, :4], model.log_prob(other, other, y)[:, :4])


def test_gradients_do_not_follow_how_windows_are_grouped(monkeypatch):
    """Also with positions that are not valid, and against scores that do not fit an exponential."""
    rng = np.random.default_rng(1)
    prior = rng.normal(0, 1, (lm.INPUTS, lm.CLASSES))
    for far in (0, 200):
        prior[:50] += far
        model = lm.Attention(lm.Attention.start() + rng.normal(0, 0.1, len(lm.Attention.start())), prior)
        model.p = {k: v.astype(float) for k, v in model.p.items()}
        z, last, y = rng.integers(0, 60, (7, lm.LENGTH)), rng.integers(0, 60, (7, lm.LENGTH)), rng.integers(0, 20, (7, lm.LENGTH))
        valid = np.arange(lm.LENGTH) < np.array([64, 3, 0, 64, 17, 1, 40])[:, None]
        monkeypatch.setattr(lm, "SIDE_BY_SIDE", 100)
        whole, p = model.gradients(z, last, y, valid), model.log_prob(z, last, y, valid)
        assert np.isfinite(p).all() and len(p) == valid.sum()
        for at_once in (1, 3):
            monkeypatch.setattr(lm, "SIDE_BY_SIDE", at_once)
            assert np.allclose(model.log_prob(z, last, y, valid), p)
            for name, x in model.gradients(z, last, y, valid).items():
                assert np.allclose(x, whole[name], atol=1e-12), name


def test_texts_and_ids_of_the_model_are_stored_small(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("doc_id as id", "false as held_out", "text")
    coded, _ = lm.encoded(docs, (P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    plain, files = f"{tmp_path}/plain", coded.inputFiles()
    spark.read.parquet(*files).write.parquet(plain, compression="snappy")
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 0.85 * sum(os.path.getsize(f.path) for f in os.scandir(plain))


def test_lines_are_encoded_by_their_words():
    """The last word of a line and the first of the next are remembered apart, marks at ends too; ids are the library's."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    encoder, library = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
    odd = ["one two.\nThree four$$$\nfive\n's six", "a b\n\nc d", "a\t\nb c", "a \nb c", "\na b", "a b\n", "x<|endoftext|>$$$ y\n<|endoftext|>\nz<|endoftext|>!!\n12.%% w", "a b\n$$$\n%\nc", "a\r\nb c", "é$ ü%\nß&\n\u200bq r", "a b\n\x85c\n\u3000d"]
    texts = [*odd, *mixed(400, 5, "ab é12.,$%&*#!'s\n\n  |<>"), *mixed(400, 6, "abcde fgh\n."), *[a + " " + b for a in odd for b in odd]]
    for _ in range(2):
        assert encoder(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    fresh = token_files.LibraryEncoder(path)
    fresh(["one two.\nThree four$$$\nfive"])
    assert {"two", "\nThree", "four", "\nfive"} <= set(fresh.memo) and not any("\n" in k[1:] for k in fresh.memo)


def test_word_hashes_are_those_of_single_words():
    """Against plain whole numbers, a word at a time; lengths at the borders of lanes, every byte as white space or not."""
    import xxhash

    def mixed_up(h):
        h = (h ^ (h >> 31)) * int(setjoin.PRIME_B) % 2**64
        return h ^ (h >> 29)

    def plain(word):
        if len(word) > setjoin.LONG_WORD:
            return xxhash.xxh64_intdigest(word)
        h = len(word) * int(setjoin.PRIME_B) % 2**64
        for i in range(0, len(word), 8):
            h = mixed_up((h ^ int.from_bytes(word[i : i + 8], "little")) * int(setjoin.PRIME_A) % 2**64)
        return h

    texts = ["", " ", "\n\t", "a", *["x" * n + " Y" + "z" * n for n in (1, 6, 7, 8, 9, 15, 16, 17, 255, 256, 257, 600)], "".join(chr(c) + "q" for c in range(256)), "é\u3000ü \x85 \x1c\x0b\x0c", *mixed(50, 9, "aB é\t")]
    words = [re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    words = [[w for w in ws if w] for ws in words]
    h, n = setjoin.word_hashes(texts)
    assert n.tolist() == [len(ws) for ws in words] and h.tolist() == [plain(w) for ws in words for w in ws]
    assert [x.tolist() for x in setjoin.word_hashes([])] == [[], []] and [x.tolist() for x in setjoin.word_hashes(["", " "])] == [[], [0, 0]]


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, D, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, D)
        assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes], name
        docs = corpus_pipeline.written(after)
        assert docs.select("doc_id").distinct().count() == docs.count()
    items = corpus_pipeline.table(spark, D, "benchmark")
    assert decontaminate.report(docs, items).where("contaminated").isEmpty()


def brute_stages(rows, items):
    """What line dedup, the n-gram join, decontamination and encoding leave of (doc_id, text), in plain Python."""
    import base64

    import tiktoken

    before, left = [], []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            s = set(line.encode().lower().split())
            if not (s and any(100 * len(s & x) >= 80 * len(s | x) for x in before)):
                kept.append(line)
            if s:
                before.append(s)
        if len(kept) == text.count("\n") + 1 or "".join(kept).strip():
            left.append((i, "\n".join(kept)))
    sets, one = [(i, t, shingles(t)) for i, t in left], []
    reach = {i: {i} for i, _, _ in sets}
    for i, _, a in sets:
        for j, _, b in sets:
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                both = reach[i] | reach[j]
                for k in both:
                    reach[k] = both
    one = [(i, t) for i, t, s in sets if not s or min(reach[i]) == i]
    wanted = [decontaminate.words_of(x) for x in items]
    windows = {tuple(w[k : k + 10]) for w in wanted for k in range(max(1, len(w) - 9)) if w}
    out = {}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for i, text in one:
        while True:
            words = decontaminate.words_of(text)
            hit = sorted({p for w in windows for k in range(len(words) - len(w) + 1) if tuple(words[k : k + len(w)]) == w for p in range(k, k + len(w))})
            if not hit:
                ids = coder.encode_ordinary(text)
                out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                break
            if 2 * len(hit) > len(words):
                break
            spans = []
            for p in hit:
                if spans and spans[-1][1] == p:
                    spans[-1][1] = p + 1
                else:
                    spans.append([p, p + 1])
            text = decontaminate.cut_words(text, spans)
    return out


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    passage = " ".join(f"item{k}" for k in range(15))
    lines = near_copies(6, groups=6, size=4)
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 4))) for _ in range(30)]
    texts += [f"{x} {passage} {y}" for x, y in zip(near_copies(7, 3, 2), near_copies(8, 3, 2), strict=True)] + [passage, "", "one two", "x\n\nx"]
    d = put(spark, tmp_path, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS), [(1, passage.upper()), (2, None), (3, "...")])
    docs = corpus_pipeline.table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, d))
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in docs.collect()} == brute_stages(list(enumerate(texts)), [passage.upper()])


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    d = put(spark, tmp_path / "none", spark.createDataFrame([], DOCS))
    assert corpus_pipeline.run(spark, d).count() == 0
    good = [" ".join(f"w{k * 7 + j}" for j in range(60)) for k in range(12)]
    same = (7, good[0], "en", "s", 1)
    extra = spark.createDataFrame([same, same, (7, good[1], "en", "s", 1), (None, good[2], None, None, None), (None, good[2] + " more", "en", None, None), (8, good[0], "de", None, None)], DOCS)
    rows = odd_docs(spark, good[3:]).unionByName(extra).withColumns({c: F.lit("clash") for c in ("k", "t", "n_words", "items", "spans", "label", "__h", "__removed", "h")})
    d = put(spark, tmp_path / "odd", rows, [(1, ODD[17])])
    docs = corpus_pipeline.table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d))
        assert docs.columns == rows.columns and docs.where("k <> 'clash' or n_words <> 'clash' or __removed <> 'clash'").isEmpty(), name
    left = Counter(x.text for x in docs.collect())
    assert left[good[0]] == 1 and left[good[1]] == 1 and left[good[2]] + left[good[2] + " more"] == 1 and all(left[t] == 1 for t in good[3:])


def test_heaps_shrink_between_stages(spark, monkeypatch):
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 3_000_000, 1, 8).groupBy(F.sha2(F.col("id").cast("string"), 256)).count().write.format("noop").mode("overwrite").save()
    before = runtime.totalMemory() - runtime.freeMemory()
    common.shrink(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < max(before, 1)
    done = []
    monkeypatch.setattr(corpus_pipeline, "shrink", done.append)
    docs = spark.createDataFrame([(1, "a few words", "en", "s", 11)], DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D)
        assert len(done) == k + 1


def test_only_missing_pieces_are_gone_through_again():
    class Counted(dict):
        gets, others = 0, 0

        def get(self, key):
            Counted.gets += 1
            return super().get(key)

        def __getitem__(self, key):
            Counted.others += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.others += 1
            return super().__contains__(key)

    memo = Counted({" a": "A", "b": "B"})
    out = tokens.encode_pieces(["a b c b", "d", "a b"], memo, lambda ws: [f"<{w}>" for w in ws], lambda ts: [f"[{t}]" for t in ts])
    assert out == [["A", "B", "<c>", "B"], ["[d]"], ["A", "B"]] and (Counted.gets, Counted.others) == (7, 2)


@pytest.mark.parametrize("kind", ["stars", "chain", "random", "none"])
def test_components_are_brute_force_and_end_with_stars(spark, monkeypatch, kind):
    r = random.Random(5)
    links = {"stars": [(k, k % 3) for k in range(3, 60)], "chain": [(k, k + 1) for k in range(40)], "random": [(r.randrange(90), r.randrange(90)) for _ in range(70)], "none": []}[kind]
    head = {n: n for pair in links for n in pair}
    for _ in head:
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    writes, written = [], setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, *by: writes.append(1) or written(df, *by))
    got = setjoin.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, m) for n, m in head.items() if n != m)
    assert len(writes) == 1 or kind in ("chain", "random")  # what is stars already takes no round
