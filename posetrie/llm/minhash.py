"""Near duplicates by word shingles: fast similarity sketches, banding, exact verification.

Words are runs of anything but ASCII white space, after A-Z are lower-cased. A document's set has its
distinct shingles of `words` words (as 64-bit hashes); with fewer words, the whole sequence is the
one shingle; without words or text (null, empty) the set is empty and linked with nothing. Documents
are linked where 100 * |A and B| >= percent * |A or B|, and a component's least doc_id is kept.

Sketch (Dahlgaard, Knudsen and Thorup's fast similarity sketching): in round i every shingle is
hashed to a bin and a value, and an empty bin takes the least value of the first round that reaches
it. After ROWS * BANDS such rounds, one more round for each bin puts all shingles in that bin, so
every coordinate is filled; nearly always the first few rounds do. Two sets agree in a coordinate
with probability equal to their Jaccard similarity, concentrated as if coordinates were independent.

Documents with equal sets are one class, represented by its least id. Classes that share a band are
candidates. First, every member of a bucket is compared with the bucket's pivot alone (with a few, if
the bucket is crowded), the same documents in as many buckets as can be, so that a bucket of copies of
any size takes a few comparisons a member. Buckets
that still hold several components are left; their members are joined exactly, by prefixes: with all
shingles in order of their frequency among these documents, two sets at the asked similarity share
one of the rarest n - ceil(percent * n) + 1 of the larger set and of the (still fewer) rarest of the smaller, early enough
to leave room for the rest. So many documents that share a frequent passage, and differ elsewhere,
make no pairs. Candidates whose sizes or sketches rule them out are dropped, the others are compared
on their full sets; pairs that links join already aren't compared.

With 7 rows and 36 bands, a pair at similarity 0.8 misses all bands with probability 2e-4, one at 0.85 with 1e-6.

doc_id may not be null for a document to be linked sensibly. Rows that repeat a doc_id are one document:
they share a component, and are linked by any of their texts. Extra columns are not used. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from posetrie.llm.common import cut, dropped, list_array, slices, split_join, staged
from posetrie.llm.components import components

ROWS, BANDS = 7, 36
#: Pivots of a bucket that has so many members; smaller ones have one. Each is the least member after an exclusive or.
TURNS, CROWDED = (0, 0x2B992DDFA23249D6, 0x4CF5AD432745937F, 0x52DCE729DA3ED6F4), 16
T_BINS = ROWS * BANDS
#: Bits that tell which documents' texts a join asks for: 8 MB, whatever the input's size.
BITS = 1 << 26
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    found = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space alone
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    acc = np.full(len(found) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(found) - k + 1 + j])
    return np.unique(acc)


def sketch(sets: list[np.ndarray], bins: int = T_BINS) -> np.ndarray:
    """A row of bins values for each non-empty set."""
    n = len(sets)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    if not n:
        return out.reshape(0, bins)
    sizes = np.array([len(s) for s in sets])
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    open_ = np.ones(n * bins, bool)
    for i in range(2 * bins):
        h = mix(items ^ mix(np.full(1, i + 1, np.uint64))[0])
        at = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if i < bins else np.full(len(h), i - bins, np.uint64)
        slot = owner * bins + at.astype(np.int64)
        free = open_[slot]
        slot, value = slot[free], (mix(h) & np.uint64(0xFFFFFFFFFFFFFF)) | np.uint64(min(i, 255) << 56)
        np.minimum.at(out, slot, value[free])
        open_[slot] = False
        left = open_.reshape(n, bins).any(axis=1)
        if not left.any():
            break
        keep = left[owner]
        items, owner = items[keep], owner[keep]
    return out.reshape(n, bins)


_SKETCHED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("set_hash", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("marks", T.BinaryType()),
    ]
)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, set_hash, bands, marks) of docs (doc_id, text): the set's size and hash, a hash for each band, a byte for each coordinate."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x, words) for x in part.column(1).to_pylist()]
                some = [k for k, s in enumerate(sets) if len(s)]
                found = sketch([sets[k] for k in some])
                acc = np.tile(np.arange(BANDS, dtype=np.uint64), (len(some), 1))  # so that equal values in different bands differ
                for j in range(ROWS):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + found[:, j::ROWS])
                bands, marks = [np.empty(0, np.int64)] * len(sets), [b""] * len(sets)
                small = (found & np.uint64(0xFF)).astype(np.uint8)
                for row, k in enumerate(some):
                    bands[k], marks[k] = acc[row].astype(np.int64), small[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary()),
                        list_array(bands, pa.int64()),
                        pa.array(marks, pa.binary()),
                    ],
                    names=_SKETCHED.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCHED)


def sets_of(docs: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """The columns in keep and the full set of each text as items, array<bigint>."""
    rows = docs.select(*keep, "text")
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                sets = [shingles(x, words).view(np.int64) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], list_array(sets, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _bit(doc_id: Column) -> Column:
    """Where a document's bit is, from 1 on."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(BITS)) + 1


def bits_of(ids: DataFrame, name: str) -> DataFrame:
    """(bucket, bits): a bit for each id in a column of ids, as a staged() table of at most BITS bits."""
    # dealt out first, so that bits are shuffled as numbers and not as a bitmap for each task
    at = ids.select(_bit(F.col(name)).alias("at")).select("at", F.bitmap_bucket_number("at").alias("bucket")).repartition("bucket")
    return staged(at.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def asked_for(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """docs whose bit is set: all with an id that bits_of() was given and few others, so that a join with these ids shuffles few texts in vain."""
    at = _bit(F.col("doc_id"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return docs.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket").where(is_set).select(*docs.columns)


def alike(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb, ma, mb) that sizes and sketches don't rule out.

    The share of agreeing coordinate bytes estimates the similarity; it falls short of it by 0.14 (5.5
    deviations at 0.8) with probability below 1e-6.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    floor = (percent / 100 - 0.14) * T_BINS

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, T_BINS) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= floor))

    sized = pairs.where((100 * F.least("na", "nb")) >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "ma", "mb").mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets, as a staged() table.

    b is the pivot, which may be in very many pairs: its set goes to as many salted copies as it has
    hundreds of pairs, so that no task gets all of them. Sets are made where texts meet the pairs, and
    each is shuffled once. The ids that ask for texts are written first: as tables of known size, Spark broadcasts
    them while they are small and shuffles no text for them; where they are large, it shuffles the texts asked for.
    """
    salts = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts")))
    salted = staged(pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")))
    of_a, of_b = bits_of(salted, "a"), bits_of(salts, "b")
    members = sets_of(asked_for(docs, of_a).join(salted, F.col("doc_id") == F.col("a")), words, ["a", "b", "salt"])
    pivots = sets_of(asked_for(docs, of_b).join(salts, F.col("doc_id") == F.col("b")), words, ["b", "salts"])
    copies = pivots.select("b", F.col("items").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = members.join(copies, ["b", "salt"])
    common = F.size(F.array_intersect("items", "ib"))
    found = staged(both.where(100 * common >= percent * (F.size("items") + F.size("ib") - common)).select("a", "b").distinct())
    dropped(salts, salted, of_a, of_b)
    return found


def prefix_pairs(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, label) of different labels, among which are all at percent similarity.

    An exact filter by prefixes and positions; b is the smaller set.
    """
    bits = bits_of(members, "rep")
    sets = staged(sets_of(asked_for(docs, bits).join(members, F.col("doc_id") == F.col("rep")), words, ["rep", "label"]))
    dropped(bits)
    items = sets.select(F.col("rep").alias("id"), "label", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1")  # the others needn't be sent
    own = Window.partitionBy("id").orderBy("often", "item")
    placed = split_join(items, often, "item", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("pos", F.row_number().over(own))
    # items shared by an i-th and j-th place leave room for 1 + min(n - i, n' - j) in common
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = staged(placed.where((F.col("pos") <= probe) & (F.col("often") > 1)).select("item", "id", "label", "n", "pos"))
    dropped(sets)
    a, b = prefix.alias("a"), prefix.alias("b")
    least = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    fits = (
        (F.col("a.item") == F.col("b.item"))
        & (F.col("a.label") != F.col("b.label"))
        & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") > F.col("b.id"))))
        & (100 * F.col("b.n") >= percent * F.col("a.n"))
        & (1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= least)
    )
    found = staged(a.join(b, fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
    dropped(prefix)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = staged(sketches(docs, words))
    some = found.where("n > 0")
    classes = some.groupBy("set_hash", "n").agg(F.min("doc_id").alias("rep"))
    own = some.join(classes.select("rep", F.col("set_hash").alias("h")), (F.col("doc_id") == F.col("rep")) & (F.col("set_hash") == F.col("h")))
    nodes = staged(own.select("rep", "n", "marks", "bands").distinct())
    keys = nodes.select("rep", F.explode("bands").alias("bucket"))
    turned = [F.min(F.col("rep").bitwiseXOR(F.lit(t))).bitwiseXOR(F.lit(t)) for t in TURNS]
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *(x.alias(f"pivot{k}") for k, x in enumerate(turned))).where("members > 1")
    buckets = staged(split_join(keys, shared, "bucket"))
    every = F.array(*(f"pivot{k}" for k in range(len(TURNS))))
    pivots = F.slice(every, F.lit(1), F.when(F.col("members") >= CROWDED, len(TURNS)).otherwise(1))

    def linked(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
        b = nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
        likely = staged(alike(pairs.join(a, "a").join(b, "b"), percent))
        sure = verified(likely, docs, words, percent)
        dropped(likely)
        return sure

    def labels(links: DataFrame) -> DataFrame:
        return components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))

    stars = linked(buckets.select(F.col("rep").alias("a"), F.explode(pivots).alias("b")).where("a <> b").distinct())
    live = buckets.select("bucket", "rep").join(labels(stars), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = live.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    left = staged(split_join(live, mixed, "bucket").select("rep", "label").distinct())
    candidates = prefix_pairs(left, docs, words, percent)
    more = linked(candidates)
    label = labels(stars.unionByName(more))
    classes = cut(classes)
    plain = cut(found.select("doc_id", "n", "set_hash"))
    dropped(found, nodes, buckets, left, candidates, stars, more)
    of_class = classes.join(label, "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("label"))
    joined = plain.join(of_class, "set_hash", "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, more) without the documents that near_duplicates() doesn't keep.

    Rows without an id stay; rows that repeat an id stay or go together.
    """
    found = near_duplicates(docs.select("doc_id", "text"), words, percent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
