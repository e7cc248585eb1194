"""Mixing sources to target weights by hash thresholds, in DataFrame operations alone.

Every document has a fixed place: a 60-bit hash of its id, its text and the seed. A source takes the documents
whose hash lies below its threshold, so that a larger budget always takes a superset (thresholds are
nested) and reruns agree. The threshold comes from histograms: words by source and bucket of the
hash's leading bits, a running sum over the buckets, then again over the next bits of the one bucket
in which the budget ends, and so on. Nothing is sorted, and no level's histogram has more than
2**BITS rows a source.

Targets: sources in code-point order (null last) weigh as `weights` repeats and share all words; no
target is beyond `most` times its source's size, and what is cut off is shared again by weight among
the rest. A budget beyond a source's size takes the whole source as often as it fits and the rest by
threshold. The document at the threshold is taken if that brings the sum nearer to the target.

Null and empty texts have size 0; a source of size 0 has target 0 and its documents are taken 0
times. Rows that repeat an id and a text in a source share a hash and are taken alike; rows without an
id are told apart by their texts. A null source is a source of its own. An
empty table gives an empty table. Columns beyond the two used stay with the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from posetrie.llm.common import cut, n_words

BITS, LEVELS = 12, 5
#: Sources up to which their table (some 100 bytes a row) is broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 50_000
_HEX = BITS // 4


def place(key: Column, seed: int) -> Column:
    """The leading 15 hexadecimal digits of a hash of the key."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, _HEX * LEVELS)


def bucket(at: Column, level: int) -> Column:
    return F.conv(F.substring(at, 1 + _HEX * level, _HEX), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row a source, so one window over them is small.

    Filling by weight: sources in order of the level at which they are full (most * size / weight);
    the first k are full where the level that the others would share lies beyond the k-th's own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    full = ranked.withColumn("most", most * F.col("source_size").cast("double")).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, from_here = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    shared = full.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn(
        "share", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    )
    # the sources that aren't full have the share of the first of them
    level = shared.withColumn("rest", F.min(F.when(F.col("level") > F.col("share"), F.struct("level", "share"))).over(whole)["share"])
    return level.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("rest") * F.col("weight"), F.col("most"))).alias("target"))


def sized(docs: DataFrame, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(source, size, at) and the columns in keep, for docs with doc_id, source and text."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return docs.select("source", n_words(F.col("text")).alias("size"), place(own, seed).alias("at"), *keep)


def by_source(rows: DataFrame, per_source: DataFrame, n: int) -> DataFrame:
    """rows joined to their source's row; the n sources are broadcast if they are few."""
    right = per_source.withColumnRenamed("source", "of_source")
    right = F.broadcast(right) if n <= MOST_BROADCAST else right
    return rows.join(right, rows["source"].eqNullSafe(right["of_source"])).drop("of_source")


def thresholds(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """(source, prefix, last) of (source, budget): documents whose place is below prefix are taken, those in it if last.

    rows: (source, size, at). Only the boundary bucket goes on to the next level, and only until one
    document is left in it.
    """
    live = budgets.select("source", "budget", F.lit(0).cast("long").alias("below"), F.lit("").alias("prefix"))
    for level in range(LEVELS):
        inside = by_source(rows, live.select("source", "prefix"), n).where(F.startswith("at", "prefix"))
        histogram = inside.groupBy("source", bucket(F.col("at"), level).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        running = histogram.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        beyond = by_source(running, live.select("source", "budget", "below", "prefix"), n).where(F.col("below") + F.col("upto") > F.col("budget"))
        end = beyond.groupBy("source", "budget", "below", "prefix").agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("end"))
        live = cut(
            end.select(
                "source",
                "budget",
                (F.col("below") + F.col("end.upto") - F.col("end.words")).alias("below"),
                F.concat("prefix", F.lower(F.lpad(F.hex("end.bucket"), _HEX, "0"))).alias("prefix"),
                F.col("end.words").alias("words"),
                F.col("end.n").alias("n"),
            )
        )
        if (live.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    return live.select("source", "prefix", (F.col("budget") - F.col("below") > F.col("words") / 2).alias("last"))


def plan(rows: DataFrame, weights: Sequence[float], most: int = 3) -> DataFrame:
    """(source, source_size, target, whole, prefix, last, n_sources) of rows (source, size, at); a row for each source."""
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, float(most)))
    n = goal.count()
    some = F.col("source_size") > 0
    whole = F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    # words are whole numbers, so that a budget a little below the source's size means all of it
    budget = F.least(F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)), F.col("source_size") - 0.25)
    goal = goal.withColumn("whole", whole).withColumn("budget", budget)
    edges = thresholds(rows.select("source", "size", "at"), goal.where(some), n).withColumnRenamed("source", "of_source")
    joined = goal.join(edges, goal["source"].eqNullSafe(edges["of_source"]), "left")
    return cut(joined.select("source", "source_size", "target", "whole", "prefix", "last").withColumn("n_sources", F.lit(n)))


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes each document."""
    first = plan.select("n_sources").first()
    mixed = by_source(rows, plan.drop("n_sources"), first[0] if first else 0)
    below = (F.col("at") < F.col("prefix")) & ~F.startswith("at", "prefix") | (F.startswith("at", "prefix") & F.col("last"))
    copies = F.when(F.col("source_size") > 0, F.col("whole") + F.coalesce(below, F.lit(False)).cast("int")).otherwise(0)
    return mixed.withColumn("copies", F.least(copies, F.ceil(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("int")).drop("whole", "prefix", "last")


def mixed(docs: DataFrame, weights: Sequence[float], most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: every row of docs (doc_id, source, text, more) as often as it is taken."""
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), seed, ["row"])
    taken = take(rows, plan(cut(rows.drop("row")), weights, most)).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "row").select("row.*")
