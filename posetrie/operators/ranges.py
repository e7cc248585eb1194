"""Ranges of paths: a table of paths cut into sorted pieces of like size, and what a piece needs from those before it.

Keys are paths, with more after a colon where rows of one path are to be told apart; a colon sorts after
every digit, so that a node stands before what carries on from it. Range r holds the keys from the r-th
bound on and below the next. If p is a prefix of q and p < bound <= q, then p is a prefix of the bound:
all that a range needs from earlier ones are the prefixes of its own bound, and a node whose rows lie in
several ranges is a prefix of one of their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARK = ":"
#: Rows of a range at most, unless that makes more ranges than MOST; sampled keys for each range, which the driver sorts.
ROWS, MOST, SAMPLED = 50_000, 4096, 32
#: Ranges for each shuffle partition, which a hash deals out, so that none gets much more than another; rows of a range that aren't cut for that.
SPREAD, LEAST = 16, 4000


def bounds(keys: DataFrame, rows: int = ROWS, most: int = MOST) -> list[str]:
    """The keys at which ranges 1, 2, ... begin, by a sample of a table of one column, key. Some MOST * SAMPLED keys at most come to the driver."""
    total = keys.count()
    even = min(SPREAD * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST)
    wanted = min(most, max(total // rows, even) + 1)
    if wanted == 1:
        return []
    sample = sorted(r[0] for r in keys.sample(min(1.0, SAMPLED * wanted / total), seed=wanted).collect())
    return sorted({sample[k * len(sample) // wanted] for k in range(1, wanted)} if sample else ())


def _listed(at: list[str]) -> Column:
    """The bounds as one constant."""
    return F.split(F.lit(",".join(at)), ",")


def number(key: Column, at: list[str]) -> Column:
    """The range of a key: how many bounds are at most it, by halving."""
    if not at:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(at).bit_length()))))

    def halved(held: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(_listed(at), n + step - 1) <= held, step).otherwise(0))

    # as an item of an array the key is worked out once; named in the fold, its expression would be at every step
    return F.get(F.transform(F.array(key), halved), F.lit(0))


def around(of: Column, at: list[str]) -> tuple[Column, Column]:
    """The bound that a range begins at and the next one's; null at either end."""
    return F.get(_listed(at), of - 1), F.get(_listed(at), of)


def is_shared(path: Column, of: Column, at: list[str]) -> Column:
    """Whether a node of a range may have rows in another range too."""
    if not at:
        return F.lit(False)
    low, high = around(of, at)
    return F.coalesce(F.startswith(low, path), F.lit(False)) | F.coalesce(F.startswith(high, path), F.lit(False))


def prefixes(spark: SparkSession, at: list[str], width: int) -> DataFrame:
    """(range, key): every prefix of every range's bound; some 13 rows a range."""
    rows = []
    for r, bound in enumerate(at, 1):
        digits = bound.split(MARK)[0]
        rows += [(r, digits[:n]) for n in range(0, len(digits) + 1, width)]
    return spark.createDataFrame(rows, "range int, key string")
