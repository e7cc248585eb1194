"""What the training-data operators share: input columns, checkpoints, text units."""

from __future__ import annotations

import contextlib
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word is a run of anything but these; as a class of regular expressions, for Java, Python and RE2 alike.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one if all is on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="posetrie-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark removes the shuffle files of each query when the query ends, and gives Python smaller batches."""
    mine = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {name: spark.conf.get(name) for name in mine}
    for name, value in mine.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that no lost executor takes them along.

    Spark removes the files with the DataFrame's last use where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder, for large steps between; dropped() removes it.

    Small steps are cut() instead: where Spark finds a side empty it may end a query before all its
    tasks, and these would wait for shuffle files that are gone.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes what staged() has written, once nothing lazy reads it any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right, an aggregate by key, such that Spark may split what one key has of left's rows.

    A join on the key alone takes the aggregate as its shuffle has dealt it, and then no side may be
    split; a hash beside the key makes Spark deal both sides anew.
    """
    return left.withColumn("dealt_by", F.hash(key)).join(right.withColumn("dealt_by", F.hash(key)), [key, "dealt_by"], how).drop("dealt_by")


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given: extra columns and clashing names go."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def n_words(text: Column) -> Column:
    """The number of words of a text, without an array of them; null counts 0."""
    marks = F.regexp_replace(text, rf"[{SPACE}]*+{WORD}+[{SPACE}]*+", "w")
    return F.when(F.regexp_like(text, F.lit(rf"[^{SPACE}]")), F.length(marks)).otherwise(0).cast("long")


#: The characters of SPACE, for functions that take a set of characters.
BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def lower_az(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is; where all is ASCII, lower() does the same faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


#: Rows that a worker takes up at a time; bounds its memory where Spark's Arrow batches are larger.
SLICE = 256


def slices(batch: pa.RecordBatch, n: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def add_column(df: DataFrame, source: str, make: Callable[..., pa.Array], name: str, kind: T.DataType, setup: Callable | None = None) -> DataFrame:
    """df and one more column that make computes from slices of a column.

    setup, if given, runs once in each task; make then gets its result as a second argument.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    at = df.columns.index(source)

    def run(batches):
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch):
                column = make(part.column(at), *state)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])

    return df.mapInArrow(run, schema)


def rows_of(lists: pa.ListArray) -> Iterator:
    """The items of each row of a list column as numpy arrays; None for null."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for k, null in enumerate(lists.is_null().to_pylist()):
        yield None if null else values[offsets[k] : offsets[k + 1]]


def list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of the arrays."""
    values = np.concatenate(arrays) if arrays else []
    offsets = [0]
    for a in arrays:
        offsets.append(offsets[-1] + len(a))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
