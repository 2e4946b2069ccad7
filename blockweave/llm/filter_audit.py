"""How five text filters overlap, whatever order they are applied in.

Words are exploded and counted as rows: a (text, word) aggregate, then one over texts.  The other flags are joined to
it, and one aggregate makes 32 conditional counts for each part, one for each set of filters that a document fails.  All
orders of the filters follow from these counts without another look at the documents.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

FILTERS = "ABCDE"
COUNTED = ["n", "good", "toxic"]
MASKS = range(1 << len(FILTERS))
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """For each distinct text with a word: digest, n_rows_words (words of all rows that hold it), n_distinct, capitals, symbols.

    A text goes to one task, its words never leave it: rows are dealt by the text's digest and the part of the input
    they come from, so that copies of one text are many tasks, and both aggregates use that partitioning.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.char_length(text)
    capitals = 100 * (length - F.char_length(F.translate(text, CAPITALS, ""))) > MAX_CAPITAL_PERCENT * length
    # the texts' own flags go before the shuffle: behind the generator they would be worked out for each word
    texts = docs.select(text.alias("text"), _digest(text).alias("digest"), F.spark_partition_id().alias("salt"), capitals.alias("capitals"), text.rlike(SYMBOLS).alias("symbols"))
    words = texts.repartition("digest", "salt").select("digest", "salt", "capitals", "symbols", F.explode(F.split("text", BLANKS)).alias("word"))
    keys = ["digest", "salt", "capitals", "symbols"]
    per_word = words.filter("word <> ''").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    per_part = per_word.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    # the words of a text are the same in each part, only the number of rows differs
    return per_part.groupBy("digest").agg(F.sum("n").alias("n_rows_words"), F.max("n_distinct").alias("n_distinct"), F.max("capitals").alias("capitals"), F.max("symbols").alias("symbols"))


def failing_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part: part, and for each set of filters (bit i is filter i of FILTERS) the documents that fail just these.

    Columns n_0 to n_31 count all documents, good_0 to good_31 those with quality 1, toxic_0 to toxic_31 those with
    toxic 1.  Filters: A under 100 words; B distinct words under 80 % of the words; C capitals A-Z over 10 % of the code
    points; D holds one of # $ % & * |; E a smaller id has the same text.

    Each row counts, rows that repeat too; of equal texts those with the smallest id pass E, and so do rows with a null
    id.  A null text is empty, a null part an empty string.  Several labels of one id: the largest counts.  An
    empty table has no part, so no row.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), _digest(text).alias("digest"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(n) for n, c in zip(COUNTED[1:], ("quality", "toxic"), strict=True)])
    rows = rows.groupBy("digest", "part", "id").agg(F.count(F.lit(1)).alias("n")).join(marks, "id", "left")
    rows = rows.select("digest", "part", "id", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in COUNTED[1:]])
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *COUNTED)))
    nameless = [F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col(c))), F.lit(0)).alias(f"null_{c}") for c in COUNTED]
    groups = materialize(rows.groupBy("digest", "part").agg(first.alias("first"), *[F.sum(c).alias(c) for c in COUNTED], *nameless), "texts")
    texts = groups.groupBy("digest").agg(F.min("first.id").alias("least"), F.sum("n").alias("n_rows"))
    # a text without words is in no word statistics, but in the counts
    texts = texts.join(word_statistics(docs, text_col), "digest", "left")
    n_words = F.coalesce(F.expr("n_rows_words div n_rows"), F.lit(0))
    fails = [n_words < MIN_WORDS, 100 * F.coalesce("n_distinct", F.lit(0)) < MIN_DISTINCT_PERCENT * n_words, F.coalesce("capitals", F.lit(False)), F.coalesce("symbols", F.lit(False))]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    known = groups.join(texts.select("digest", "least", mask.alias("mask")), "digest")
    passing = {c: F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) + F.col(f"null_{c}") for c in COUNTED}
    copy = 1 << FILTERS.index("E")
    passed = F.struct(F.col("mask"), *[p.alias(c) for c, p in passing.items()])
    copied = F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - p).alias(c) for c, p in passing.items()])
    both = known.select("part", F.inline(F.array(passed, copied)))
    # a conditional count for each set: summed by part and set first, then laid out side by side
    wide = both.groupBy("part").pivot("mask", list(MASKS)).agg(*[F.sum(c).alias(c) for c in COUNTED])
    return wide.select("part", *[F.coalesce(F.col(f"{m}_{c}"), F.lit(0)).alias(f"{c}_{m}") for c in COUNTED for m in MASKS])


def _total(value, holds=lambda s: F.lit(True)) -> Column:
    """Sum of ``value`` over the sets of filters for which ``holds`` is true."""
    return F.aggregate(F.transform(F.filter("sets", holds), value), F.lit(0).cast("long"), lambda a, x: a + x)


def filter_audit(sets: DataFrame) -> DataFrame:
    """What each filter removes at each place of each order, from the counts of ``failing_sets``.

    One row per part, order (all permutations of FILTERS, applied left to right) and step (from 1; its filter is that
    letter), zeros included.  Long counts within the part: kept (after this step), removed (here), redundant
    (failing its filter but removed earlier), unique_fails (failing its filter only), good_lost and toxic_lost (removed
    here with quality 1, toxic 1), shapley (removed by its filter, summed over all orders at any step).  No parts give no rows.
    """
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    plan = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), x, strict=True)) for x in steps])), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    # of the orders, a filter comes first among the k that a document fails in 1 / k
    counts = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(factorial(len(FILTERS)) // max(1, m.bit_count())).alias("orders"), *[F.col(f"{c}_{m}").alias(c) for c in COUNTED]) for m in MASKS])
    rows = sets.select("part", counts.alias("sets")).select("*", F.explode(plan).alias("at")).select("*", "at.*")
    fails = lambda s: s.mask.bitwiseAND(F.col("bit")) != 0
    stayed = lambda s: s.mask.bitwiseAND(F.col("before")) == 0
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total(lambda s: s.n, lambda s: ~fails(s) & stayed(s)).alias("kept"),
        _total(lambda s: s.n, lambda s: fails(s) & stayed(s)).alias("removed"),
        _total(lambda s: s.n, lambda s: fails(s) & ~stayed(s)).alias("redundant"),
        _total(lambda s: s.n, lambda s: s.mask == F.col("bit")).alias("unique_fails"),
        _total(lambda s: s.good, lambda s: fails(s) & stayed(s)).alias("good_lost"),
        _total(lambda s: s.toxic, lambda s: fails(s) & stayed(s)).alias("toxic_lost"),
        _total(lambda s: s.n * s.orders, fails).alias("shapley"),
    )
