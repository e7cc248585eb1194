"""How filters interact: what each removes, alone and after others, in every order in which they may run.

Five filters on whole texts (a null text counts as empty); a word is a maximal run of other characters
than white space, and a document fails
  A  with fewer than 50 words,
  B  if 100 * distinct words < 65 * words (so never without words),
  C  if 100 * characters A-Z > 5 * code points,
  D  if it holds one of #$%&*|,
  E  if a row with a smaller doc_id, of whatever source, has the same text.
Texts are compared by 128 bits of hash and their length. A row without an id never fails E and makes no
other row fail it; rows of one id don't make each other fail. A label counts for all rows of its id, and
several labels of an id count together: one of quality 1 is enough to be good, one of toxic 1 to be toxic.

Documents become a mask of five bits, and are counted by part and mask: at most 32 cells a part, whatever
the part's size, so that a part with a third of all rows is met by partial aggregation alone. The cells
are then unpivoted against the 600 steps of the 120 orders; a running bit-or over a cell's steps tells
what has failed earlier, conditional sums over the cells give each step's figures, and windows by filter
its total over all orders. A part is a source, null as the empty string. An empty table has no parts and
no rows. Columns beyond the ones used don't matter.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from posetrie.llm.common import BLANKS, cut, dropped, pick, staged

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def _words(text: Column) -> Column:
    spaced = text
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h1, h2, n_chars, mask) of docs (doc_id, source, text): bits 0 to 3 of the mask are filters A to D."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counted = text.select("*", _words(F.col("text")).alias("words")).select(
        "doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.length("text").alias("n_chars")
    )
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = [
        F.col("n") < LEAST_WORDS,
        100 * F.col("distinct").cast("long") < LEAST_DISTINCT * F.col("n").cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.col("n_chars").cast("long"),
        F.regexp_like("text", F.lit("[#$%&*|]")),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    return counted.select("doc_id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "n_chars", mask.alias("mask"))


SAME = ["h1", "h2", "n_chars"]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs (doc_id, source, text) and labels (doc_id, quality, toxic).

    Both joins are between tables that were written before, so that Spark broadcasts the smaller one
    where its size allows and else may split what one id or one text has many rows of.
    """
    rows = staged(failures(docs))
    several = rows.groupBy(*SAME).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    firsts = staged(several.drop("last"))
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(f"is_{name}")
    known = staged(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_id")).agg(flag("quality"), flag("toxic")))
    judged = rows.join(firsts, SAME, "left").join(known, F.col("doc_id") == F.col("of_id"), "left")
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    counted = judged.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_quality")).alias("good"), F.count_if(F.col("is_toxic")).alias("toxic")
    )
    found = cut(counted)
    dropped(rows, firsts, known)
    return found


def interactions(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step of cells (part, mask, n, good, toxic), with the figures of the step's filter."""
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    ordered = counted.select("*", F.explode(orders).alias("filter_order"))
    stepped = ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    long_form = stepped.select("*", letter.alias("filter"), bit.alias("bit")).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long_form.withColumn("failed", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))
    removed = (F.col("fails") > 0) & (F.col("failed") == 0)

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    figures = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("fails") == 0) & (F.col("failed") == 0)).alias("kept"),
        total(removed).alias("removed"),
        total((F.col("fails") > 0) & (F.col("failed") > 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of documents and their labels."""
    return interactions(cells(pick(docs, doc_id="doc_id", source="source", text="text"), pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")))
