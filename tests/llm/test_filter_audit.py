"""The replay of filter orders against a plain replay."""

import itertools
import random
import re
from collections import Counter, defaultdict

from hourloom.llm import filter_audit

DOCS = "doc_id long, text string, source string, step int, filter_order string"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    said = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            said[i][0] |= quality == 1
            said[i][1] |= toxic == 1
    counts, parts = defaultdict(Counter), set()
    for i, text, source, *_ in rows:
        text, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
        }
        parts.add(part)
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                now = fails[f] and not gone
                good, toxic = said[i] if i is not None else (0, 0)
                counts[part, order, step].update(kept=not gone and not now, removed=now, redundant=gone and fails[f], unique_fails=fails[f] and sum(fails.values()) == 1, good_lost=now and good, toxic_lost=now and toxic)
                gone |= now
    shapley = Counter()
    for (part, order, step), c in counts.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(int(c[n]) for n in names), shapley[p, o[s - 1]]) for (p, o, s), c in counts.items()}, len(parts)


def test_audit_is_a_plain_replay(spark):
    r = random.Random(3)
    texts = [None, "", " \t\x0b ", "A B C", "word " * 250, "É\xa0x $", *(" ".join(r.choice(["some", "Word", "x#", "y", f"w{r.randrange(400)}"][: r.randint(1, 5)]) for _ in range(r.randint(0, 300))) for _ in range(30))]
    texts += ["long text " + " ".join(f"u{i}" for i in range(30_000))]
    rows = [(r.randrange(10**6), r.choice(texts), r.choice([None, "", "a", "b"]), 7, "x") for _ in range(120)]
    rows += [rows[0], rows[1], (None, "", "a", 7, "x"), (None, texts[9], "c", 7, "x"), (rows[2][0], "another text of one id", "b", 7, "x")]
    labels = [(x[0], r.choice([0, 1, None]), r.choice([0, 1, None])) for x in r.sample(rows, 70)] + [(None, 1, 1), (rows[3][0], 1, 0), (rows[3][0], 0, 1), (-1, 1, 1)]
    out = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    expected, parts = plain(rows, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(x[n] for n in names) for x in out.collect()]
    assert len(got) == 600 * parts and set(got) == expected
    assert dict(out.dtypes)["step"] == "int" and all(dict(out.dtypes)[n] == "bigint" for n in names[3:])


def test_no_documents_no_labels(spark):
    empty = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), empty).count() == 0
    got = filter_audit.audit(spark.createDataFrame([(1, "a # b", "s", 0, "")], DOCS), empty).where("filter_order = 'DABCE'").orderBy("step").collect()
    assert [(x.kept, x.removed, x.redundant) for x in got] == [(0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)] and got[0].shapley == 60


def test_copies_are_joined_by_id_not_by_text(spark):
    """A text that all documents have is no hot key: what is joined is one row for each text, by its least id."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) as text", "'s' as source")
    flagged = filter_audit.flags(docs, spark.createDataFrame([], LABELS))
    assert flagged.where("(fails & 16) != 0").count() == 999
