"""Filter interaction audit (operator 13): every order of five filters replayed over every document.

A document's failures are five bits. Documents meet the 120 orders (a table of fixed size, sent to every task), the first filter of an
order that a document fails is the one that removes it, five steps are exploded, and counts are added up within each task before they
are shuffled, so a part of any size is no hot spot. Filters, from the whole text: A, fewer than 200 words; B, distinct words under half
of the words; C, more than 2 capitals A-Z in 100 code points; D, any of ``#$%&*|``; E, a text that a smaller id has too.

Null texts are empty: they fail A, and E if a smaller id is empty or null too; 0 words are not under half of 0. Rows with equal ids and texts are no copies of
each other; a null id is neither smaller nor larger than any. A null part is the empty string and one with it. A document with several
rows of labels has a label if one row says so; ids without labels, and null labels, have none. Very long texts take memory in proportion to
themselves. No ties arise: an order removes a document once. An empty table gives an empty result. Further columns, of any names, are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the audit.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
#: Documents that a task replays at most, about: 600 short rows come of each.
TASK_DOCS = 40_000

BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * capitals > CAPITALS_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(fails[f], BIT[f]).otherwise(0) for f in fails), F.lit(0))


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails (bits), good and toxic of every row of ``docs``, written."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # 256 bits name a text; only its name moves
    rows = written(rows.select("id", "part", failures(F.col("text")).alias("fails"), F.unhex(F.sha2("text", 256)).alias("name")))
    # the least id of each text meets its own row by id: no key of copies is ever joined
    first = rows.where("id is not null").groupBy("name").agg(F.min("id").alias("id"))
    first = first.select("id", "name", F.lit(0).alias("copy"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("copy", F.lit(BIT["E"])))
    return written(
        rows.join(said, "id", "left").join(first, ["id", "name"], "left")
        .select("part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def all_orders(spark) -> DataFrame:
    """filter_order and the bits of its steps b1 to b5: 120 rows, always."""
    rows = [("".join(o), *[BIT[f] for f in o]) for o in itertools.permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{k} int" for k in range(1, len(FILTERS) + 1)))


def replay(flagged: DataFrame) -> DataFrame:
    """Counts of every part, order and step of rows of ``flags`` (written: they are counted)."""
    spark, steps = flagged.sparkSession, range(1, len(FILTERS) + 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flagged.count() // TASK_DOCS))
    crossed = flagged.repartition(tasks).crossJoin(F.broadcast(all_orders(spark)))
    fails = lambda k: F.col("fails").bitwiseAND(F.col(f"b{k}")) != 0
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(steps):
        first = F.when(fails(k), k).otherwise(first)
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in steps])).alias("at")
    rows = crossed.withColumn("first", first).select("part", "filter_order", "fails", "good", "toxic", "first", step).select("*", "at.step", "at.bit")
    removed, failing = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counts = rows.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & (F.col("good") == 1)).alias("good_lost"),
        F.count_if(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    counts = written(counts)  # 600 rows a part
    by_filter = ["part", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter")]
    shapley = counts.groupBy(*by_filter).agg(F.sum("removed").alias("shapley")).withColumnRenamed("part", "p")
    same = (F.col("part") == F.col("p")) & (F.substring("filter_order", F.col("step"), F.lit(1)) == F.col("filter"))
    return counts.join(shapley, same).drop("p", "filter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for every part of ``docs``, order of the filters and step. ``labels``: ids (of the same name) with quality and toxic."""
    return replay(flags(docs, labels, id_col, text_col, part_col))
