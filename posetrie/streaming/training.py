"""Training on a stream: counts grow with every micro-batch, labels are finalised when asked for.

The counts are a log-structured store. Every batch writes a run of its own counts; FANOUT runs of a level
are merged into one of the next, so that a reader sums at most (FANOUT - 1) runs a level, and there are as
many levels as the logarithm of the batches. A version file for each batch lists the runs that hold all
up to it; a reader takes the greatest and sees that batch and those before, whatever is being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from posetrie.config import DEFAULT, PoseConfig
from posetrie.operators import train
from posetrie.sources.versions import Folder

#: Runs of a level that are merged, and versions whose runs stay for readers that have begun.
FANOUT, KEPT = 4, 3


def add(batch: DataFrame, number: int, folder: str, config: PoseConfig = DEFAULT, fanout: int = FANOUT) -> None:
    """Takes samples (path, label) as the batch of a number. A batch that is there already changes nothing; one that was broken off is written anew."""
    spark = batch.sparkSession
    store = Folder(spark, folder)
    before = [n for n in store.numbers() if n < number]
    if number in store.numbers():
        return
    runs = store.read(before[-1])["runs"] if before else []

    def written(counted: DataFrame, name: str) -> str:
        counted.write.mode("overwrite").parquet(f"{store.path}/runs/{name}")
        return name

    runs = [*runs, {"level": 0, "name": written(train.counts(batch, config), f"{number}-{number}")}]
    while len(runs) >= fanout and len({r["level"] for r in runs[-fanout:]}) == 1:
        last = runs[-fanout:]
        name = f"{last[0]['name'].split('-')[0]}-{number}"
        merged = train.merge(*(spark.read.schema(train.COUNTS).parquet(f"{store.path}/runs/{r['name']}") for r in last))
        runs = [*runs[:-fanout], {"level": last[0]["level"] + 1, "name": written(merged, name)}]
    store.commit(number, {"runs": runs})
    _clean(store, before)


def _clean(store: Folder, before: list[int]) -> None:
    """Removes versions that are KEPT or more behind, and runs that no later one lists."""
    for n in before[: 1 - KEPT]:
        later = {r["name"] for m in store.numbers() if m > n for r in store.read(m)["runs"]}
        for run in store.read(n)["runs"]:
            if run["name"] not in later:
                store.remove(f"runs/{run['name']}")
        store.remove(f"versions/{n}")


def start(samples: DataFrame, folder: str, once: bool = False, config: PoseConfig = DEFAULT) -> StreamingQuery:
    """Counts of the stream's samples (path, label), kept under folder."""

    def keep(batch: DataFrame, number: int) -> None:
        add(batch, number, folder, config)

    writer = samples.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The runs that hold all batches so far."""
    latest = Folder(spark, folder).latest()
    return [r["name"] for r in latest["runs"]] if latest else []


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts so far."""
    held = [spark.read.schema(train.COUNTS).parquet(f"{folder}/runs/{name}") for name in runs(spark, folder)]
    return train.merge(*held) if held else spark.createDataFrame([], train.COUNTS)


def run_once(samples: DataFrame, folder: str, config: PoseConfig = DEFAULT) -> DataFrame:
    """Finalised nodes after all that the stream has now."""
    start(samples, folder, once=True, config=config).awaitTermination()
    return train.nodes(counts(samples.sparkSession, folder))
