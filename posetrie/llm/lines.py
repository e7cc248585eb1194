"""Dropping lines that many documents share, by levelled sorted runs of line hashes.

Texts are split at \\n (a null or empty text has one empty line). A line's key is the line without white
space at both ends, A-Z in lower case. Keys of `least_chars` code points or more that `least_documents`
documents hold lose all their lines except in the greatest doc_id that holds them; other lines stay.
A key stands as 128 bits of hash. Rows of one doc_id are one document, those without an id too, whose
id is below all others. Repeated rows are treated alike.

Documents come in batches. A batch's keys are merged against every run, a table bucketed and sorted
by hash: keys that are in no run (anti-joins) are written as a run of their own, so that a key stands in
exactly one run; for those that are in one, what they add is logged. Every FANOUT runs of a level are
compacted to one of the next, which needs no sums since runs have no key in common. The log alone tells
which keys are frequent: its size follows the keys that two documents or more share, not the corpus.

All is keyed by hash after a partial aggregation, so that a line that all documents hold is one row a
task. Frequent keys meet the lines, and a document its dropped lines, in joins of written tables, which
Spark may split or broadcast by their size. Texts are shuffled at most once. An empty table gives an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posetrie.llm.common import BLANKS, dropped, lower_az, new_folder, staged

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Batches that a whole table is taken in, and runs of a level that are compacted to one.
BATCHES, FANOUT = 8, 4
KEY = ["h1", "h2"]


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2): the lines of docs (doc_id, row, text) with long keys."""
    each = docs.select("doc_id", "row", F.posexplode(split(F.col("text"))).alias("pos", "line"))
    some = each.select("doc_id", "row", "pos", trimmed(F.col("line")).alias("line")).where(F.length("line") >= least_chars)
    keyed = some.select("doc_id", "row", "pos", lower_az(F.col("line")).alias("key"))
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Levelled runs of (h1, h2, n, last): a key, the documents that held it in the batch that brought it, the greatest of them.

    Runs are bucketed by hash, as many buckets as the session has shuffle partitions, so that neither
    side of a merge is shuffled. log: (h1, h2, more, n, last) of keys that have been met again (more:
    the documents that add to the n of their run) or that several documents of one batch hold.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.log: list[DataFrame] = []

    def _written(self, rows: DataFrame) -> str:
        name = f"posetrie_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_folder(self.spark, "run")).saveAsTable(name)
        return name

    def _gone(self, name: str) -> None:
        where = self.spark.table(name).inputFiles()[:1]
        self.spark.sql(f"DROP TABLE {name}")
        for file in where:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Takes a batch's keys (h1, h2, n, last), one row a key."""
        own = self._written(batch)
        new, met = self.spark.table(own), []
        for name in self.runs():
            run = self.spark.table(name)
            new = new.join(run, KEY, "left_anti")
            here = self.spark.table(own).withColumnsRenamed({"n": "more", "last": "own_last"})
            met.append(here.join(run, KEY).select(*KEY, "more", "n", F.greatest("last", "own_last").alias("last")))
        run = self._written(new) if met else own
        again = self.spark.table(run).where("n > 1").select(*KEY, F.lit(0).cast("long").alias("more"), "n", "last")
        for part in met:
            again = again.unionByName(part)
        self.log.append(staged(again))
        if met:
            self._gone(own)
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) < self.fanout:
                return
            whole = self.spark.table(names[0])
            for name in names[1:]:
                whole = whole.unionByName(self.spark.table(name))
            merged = self._written(whole)
            for name in names:
                self._gone(name)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)

    def frequent(self, least_documents: int) -> DataFrame:
        """(h1, h2, last) of keys that as many documents hold, and the greatest of them."""
        whole = self.log[0]
        for part in self.log[1:]:
            whole = whole.unionByName(part)
        total = whole.groupBy(*KEY).agg((F.sum("more") + F.max("n")).alias("n"), F.max("last").alias("last"))
        return total.where(F.col("n") >= least_documents).select(*KEY, "last")

    def close(self) -> None:
        for name in self.runs():
            self._gone(name)
        dropped(*self.log)
        self.levels, self.log = [[]], []


def _batch(lines: DataFrame, number: int) -> DataFrame:
    """A batch's keys; a document counts once for a key, however many rows and lines it has."""
    of = lines.where(F.col("batch") == number).groupBy(*KEY, "doc_id").agg(F.lit(1).alias("once"))
    return of.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def drops(docs: DataFrame, least_chars: int, least_documents: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, row, dropped): the places of the lines that docs (doc_id, row, text) lose, in ascending order; a written table."""
    spark = docs.sparkSession
    lines = staged(long_lines(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    runs = Runs(spark, fanout)
    try:
        for number in range(batches):
            runs.add(_batch(lines, number))
        frequent = staged(runs.frequent(least_documents))
    finally:
        runs.close()
    out = lines.join(frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    found = staged(out.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped")))
    dropped(lines, frequent)
    return found


def without(lines: Column, gone: Column) -> Column:
    """lines without the places in gone, which ascend: what lies between them, piece by piece."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(pieces)


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, kept, n_lines, n_dropped) of docs (doc_id, text, more): the row as a struct, its text without the lines that go.

    kept is the whole text where nothing goes, and null where the text is.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64("text").alias("row"))
    gone = drops(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), least_chars, least_documents, batches, fanout).withColumnsRenamed({"doc_id": "of_id", "row": "of_row"})
    joined = rows.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")
    some = F.col("dropped").isNotNull()
    lines = split(F.col("doc.text"))
    kept = F.when(some, F.array_join(without(lines, F.col("dropped")), "\n")).otherwise(F.col("doc.text"))
    return joined.select("doc", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.when(some, F.size("dropped")).otherwise(0).cast("long").alias("n_dropped"))
