"""Scores of documents by masked pseudo-likelihood.

Tokens are the classes of lower-cased words: the TOP most frequent words of all documents one class each, all other
words in OTHER classes by hash. A network sees the SIDE tokens before and the SIDE tokens after a
masked place (embeddings, one tanh layer) and predicts its token's class in two steps, the group of MEMBERS classes of
like frequency and the class in it, so that thousands of classes cost what a few hundred would in one; a document's score is the sum of
the log-probabilities of all its words: of the class, predicted from both sides, and of the word
within its class, by the counts of all documents. The latter are joined to the documents' words by Spark.
Rows are told apart there by a 64-bit hash of id and text; rows that repeat both share one mean, as they should.

Word counts cover all documents. The network is trained in numpy on the windows around every
place of every document (every rate-th one where a caller asks for that), each in one of the rounds. Trainers each take a share of the documents'
classes and make windows of them batch by batch; they start from common weights, and the means of their weights are the next round's start.
Spark sums the trainers' weights, as whole numbers, so that sums don't depend on their order. Only the mean (some 210,000 numbers a round) reaches the driver,
and the vocabulary (TOP words), whatever the input's size.

Null and empty texts have no tokens and score 0 (their score a token is null). Ties of words in
frequency go by the word's bytes. Repeated rows count and score as often as they occur. Whole texts are scored, long ones in
blocks. An empty table trains nothing and gives an empty table. Columns not in keep go.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from posetrie.llm.common import cut, fresh, slices

TOP, OTHER, SIDE, WIDTH, HIDDEN = 3840, 256, 3, 16, 32
CLASSES = TOP + OTHER
MEMBERS = 64
GROUPS = CLASSES // MEMBERS
PAD = CLASSES
RATE, ROUNDS = 1, 2
#: Windows of a step: first, at most, and the steps after which they double.
FIRST, BATCH, DOUBLED = 256, 2048, 32
#: Beyond so many trainers their shares grow; a trainer streams its share.
PER_TRAINER, MOST_TRAINERS = 4_000_000, 4096
#: Weights are summed in units of 1 / UNIT.
UNIT = 1 << 44
#: Windows that a trainer holds, and draws in random order, at a time.
HELD = 1 << 16
BLOCK = 2048
_AROUND = [o for o in range(-SIDE, SIDE + 1) if o]


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """words() of all texts in one array, and how many each text has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    held, flat = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False), found.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end gives an empty string
    owner = np.repeat(np.arange(len(held)), held)[some.to_numpy(zero_copy_only=False)]
    return flat.filter(some).cast(pa.binary()).dictionary_encode(), np.bincount(owner, minlength=len(held))


class Vocabulary:
    """Classes of words: of the most frequent by place, of others by hash."""

    def __init__(self, top: Sequence[bytes]):
        self.top = pa.array(top, pa.binary())

    def classes(self, texts: pa.Array) -> list[np.ndarray]:
        """The classes of each text's words; each different word is looked up once."""
        found, sizes = split(texts)
        if not len(found):
            return [np.empty(0, np.int16)] * len(sizes)
        own = pc.fill_null(pc.index_in(found.dictionary, value_set=self.top), -1).to_numpy(zero_copy_only=False).astype(np.int16)
        if len(others := np.flatnonzero(own < 0)):
            _, at, raw = found.dictionary.take(pa.array(others)).buffers()
            ends, raw = np.frombuffer(at, np.int32)[: len(others) + 1].tolist(), raw.to_pybytes()
            own[others] = TOP + np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(others)) % OTHER
        return np.split(own[found.indices.to_numpy(zero_copy_only=False)], np.cumsum(sizes)[:-1])


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; counts are summed in the workers first."""

    def run(batches):
        for batch in batches:
            each = []
            for part in slices(batch, 1024):
                found, _ = split(part.column(0))
                n = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
                each.append(pa.table([found.dictionary, pa.array(n, pa.int64())], ["word", "n"]))
            if each:
                count = pa.concat_tables(each).group_by("word", use_threads=False).aggregate([("n", "sum")])
                yield from pa.table([count["word"], count["n_sum"]], ["word", "n"]).to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most(counted: DataFrame) -> list[bytes]:
    """The TOP most frequent words of (word, n)."""
    return [bytes(r[0]) for r in counted.orderBy(F.desc("n"), "word").limit(TOP).collect()]


def vocabulary(docs: DataFrame) -> list[bytes]:
    """The TOP most frequent words of all texts."""
    return most(counts(docs))


def shares(counted: DataFrame, top: list[bytes]) -> DataFrame:
    """(word, share): log p(word | class) of the words without a class of their own, for which it is 0."""
    own = counted.sparkSession.createDataFrame([(bytearray(w),) for w in top], "word binary")  # TOP rows
    rest = counted.join(F.broadcast(own), "word", "left_anti").withColumn("class", F.crc32("word") % OTHER)
    whole = rest.groupBy("class").agg(F.sum("n").alias("whole"))  # OTHER rows
    return rest.join(F.broadcast(whole), "class").select("word", (F.log("n") - F.log("whole")).alias("share"))


def rare(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """(key, word, n): how often each document has each of its words without a class of their own."""
    known = frozenset(top)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, held, n = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = Counter(w for w in words(text) if w not in known)
                    keys += [key] * len(found)
                    held += found
                    n += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary()), pa.array(n, pa.int64())], names=["key", "word", "n"])

    return docs.select(_key(), "text").mapInArrow(run, "key long, word binary, n long")


def _key() -> Column:
    # the id too, so that copies of a text spread out
    return F.xxhash64("doc_id", "text").alias("key")


def stream(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' classes in one array with SIDE pads around each, and the places of the tokens."""
    gap = np.full(SIDE, PAD, np.int16)
    parts, at, places = [gap], SIDE, []
    for d in docs:
        parts += [d, gap]
        places.append(np.arange(at, at + len(d)))
        at += len(d) + SIDE
    return np.concatenate(parts), np.concatenate([np.empty(0, np.int64), *places])


def classed(docs: DataFrame, top: list[bytes], keep: Sequence[str], key: str, part: str) -> DataFrame:
    """The columns in keep, a key and the classes, 16 bits each, of every document."""
    rows = docs.select(*keep, _key().alias(key), "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(part, T.BinaryType())])

    def run(batches):
        known = Vocabulary(top)
        for batch in batches:
            for here in slices(batch, 1024):
                held = [x.tobytes() for x in known.classes(here.column(here.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*here.columns[:-1], pa.array(held, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def sequences(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """(key, part): the classes of each document that has words, 16 bits each."""
    return classed(docs, top, (), "key", "part").where("octet_length(part) > 0")


def windows(parts: Iterable[bytes], rate: int, turn: int = 0, turns: int = 1) -> Iterator[np.ndarray]:
    """The windows (2 * SIDE + 1 classes) around every rate-th token of each document, at most HELD at a time; of turns calls, each gives its own."""
    around, docs, first, n = np.arange(-SIDE, SIDE + 1), [], [], 0

    def held():
        s, at = stream(docs)
        starts = np.cumsum([0, *map(len, docs)])
        if rate > 1:
            at = np.concatenate([at[a + f : b : rate] for a, b, f in zip(starts, starts[1:], first)])
        at = at[turn::turns]
        for k in range(0, len(at), HELD):
            yield s[at[k : k + HELD, None] + around]

    for part in parts:
        docs.append(np.frombuffer(part, np.int16))
        first.append(zlib.crc32(part) % rate)
        n += len(docs[-1])
        if n >= HELD * rate * turns:
            yield from held()
            docs, first, n = [], [], 0
    if docs:
        yield from held()


class Network:
    """Weights: e (embeddings), w and b (hidden layer), g and d (groups), v and c (classes in each group)."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        wide = len(_AROUND) * WIDTH
        return cls(
            {
                "e": r.normal(0, 0.3, (CLASSES + 1, WIDTH)).astype(f),
                "w": r.normal(0, wide**-0.5, (len(_AROUND), WIDTH, HIDDEN)).astype(f),
                "b": np.zeros(HIDDEN, f),
                "g": r.normal(0, 0.1, (HIDDEN, GROUPS)).astype(f),
                "d": np.zeros(GROUPS, f),
                "v": r.normal(0, 0.1, (GROUPS, HIDDEN, MEMBERS)).astype(f),
                "c": np.zeros((GROUPS, MEMBERS), f),
            }
        )

    def dump(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.p.values()]).astype(np.float32).tobytes()

    def load(self, raw: bytes) -> Network:
        flat, at, parts = np.frombuffer(raw, np.float32), 0, {}
        for k, x in self.p.items():
            parts[k] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size
        return Network(parts)

    def train(self, rows: np.ndarray, seed: int, rate: float = 0.05, seen: dict[str, np.ndarray] | None = None) -> None:
        """One pass of AdaGrad over windows in random order; seen, from squares(), carries its state from call to call."""
        p, seen = self.p, self.squares() if seen is None else seen
        order = np.random.default_rng(seed).permutation(len(rows))
        wide, done = len(_AROUND) * WIDTH, 0
        flat = p["w"].reshape(wide, HIDDEN)
        dvc, spare = np.zeros((GROUPS, HIDDEN + 1, MEMBERS), np.float32), np.empty_like(p["v"])

        def step(k: str, g: np.ndarray) -> None:
            out = spare if g.shape == spare.shape else np.empty_like(g)
            np.multiply(g, g, out=out)
            seen[k] += out
            np.sqrt(seen[k], out=out)
            np.divide(g, out, out=out)
            out *= np.float32(rate)
            p[k] -= out

        # AdaGrad moves no weight by more than rate a step, and so no logit's bound by more than that times its weights
        limits = {"gd": np.inf, "vc": np.inf}

        def bound(which: str) -> float:
            limits[which] += (HIDDEN + 1) * rate
            if not limits[which] < SAFE:
                limits[which] = self.bound(*which)
            return limits[which]

        while done < len(order):
            size = min(BATCH, FIRST << min(int(seen["steps"][0]) // DOUBLED, 20))
            x = np.take(rows, order[done : done + size], axis=0)
            done, seen["steps"][0] = done + size, seen["steps"][0] + 1
            x = np.take(x, np.argsort(x[:, SIDE] // MEMBERS, kind="stable"), axis=0)
            group, member = np.divmod(x[:, SIDE].astype(np.int64), MEMBERS)
            runs = list(_runs(group))
            around = np.delete(x, SIDE, axis=1).ravel()
            e = np.take(p["e"], around, axis=0).reshape(-1, wide)
            h = e @ flat
            h += p["b"]
            np.tanh(h, out=h)
            q = h @ p["g"]
            q += p["d"]
            q = _surplus(q, group, len(x), bound("gd"))
            z = _surplus(self._members(h, group, runs), member, len(x), bound("vc"))
            dh, own, turned = q @ p["g"].T, np.empty_like(h), np.ones((HIDDEN + 1, len(x)), np.float32)
            turned[:-1] = h.T  # the row of ones gives the biases' gradients
            if len(runs) < GROUPS:
                dvc[:] = 0
            for k, here in runs:
                np.matmul(z[here], p["v"][k].T, out=own[here])
                np.matmul(turned[:, here], z[here], out=dvc[k])
            dh += own
            dgd = turned @ q
            h *= h
            dh *= np.subtract(1, h, out=h)
            dw, db = (e.T @ dh).reshape(p["w"].shape), turned[-1] @ dh
            # a class that isn't around has no gradient, and AdaGrad leaves it as it is
            by = np.argsort(around, kind="stable")
            sorted_ = around[by]
            starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
            found = sorted_[starts]
            de = np.add.reduceat(np.take((dh @ flat.T).reshape(-1, WIDTH), by, axis=0), starts, axis=0)
            squares = np.take(seen["e"], found, axis=0) + de * de
            seen["e"][found] = squares
            p["e"][found] -= np.float32(rate) * de / np.sqrt(squares)
            for k, g in (("w", dw), ("b", db), ("g", dgd[:-1]), ("d", dgd[-1]), ("v", dvc[:, :-1]), ("c", dvc[:, -1])):
                step(k, g)

    def bound(self, weights: str, bias: str) -> float:
        """What no logit of these weights exceeds in size, since the hidden layer is within -1 and 1."""
        return float((np.abs(self.p[weights]).sum(axis=-2) + np.abs(self.p[bias])).max())

    def squares(self) -> dict[str, np.ndarray]:
        """AdaGrad's sums of squares and number of steps before any step."""
        return {"steps": np.zeros(1, np.int64), **{k: np.full_like(x, 1e-4) for k, x in self.p.items()}}

    def sides(self) -> np.ndarray:
        """What each class adds to the hidden layer at each place around."""
        return np.stack([self.p["e"] @ w for w in self.p["w"]])

    def _members(self, h: np.ndarray, group: np.ndarray, runs: Iterable[tuple[int, slice]] | None = None) -> np.ndarray:
        """The logits of the classes of each row's own group; rows are in order of their groups, whose _runs() may be given."""
        z = np.empty((len(h), MEMBERS), np.float32)
        for k, here in _runs(group) if runs is None else runs:
            np.matmul(h[here], self.p["v"][k], out=z[here])
        z += np.take(self.p["c"], group, axis=0)
        return z

    def log_chance(self, s: np.ndarray, at: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
        """The log-probability of each token of stream s at the places, from both sides; sides() may be given."""
        p, out, sides = self.p, np.empty(len(at)), self.sides() if sides is None else sides
        groups, members = self.bound("g", "d"), self.bound("v", "c")
        for k in range(0, len(at), BLOCK):
            order = np.argsort(s[at[k : k + BLOCK]] // MEMBERS, kind="stable")
            here = at[k : k + BLOCK][order]
            group, member = np.divmod(s[here].astype(np.int64), MEMBERS)
            h = np.take(sides[0], s[here + _AROUND[0]], axis=0)
            for o, table in zip(_AROUND[1:], sides[1:]):
                h += np.take(table, s[here + o], axis=0)
            h += p["b"]
            np.tanh(h, out=h)
            z = h @ p["g"]
            z += p["d"]
            out[k + order] = _log_own(z, group, groups) + _log_own(self._members(h, group), member, members)
        return out


def _runs(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and where it stands."""
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    return ((int(group[a]), slice(a, b)) for a, b in zip(starts, [*starts[1:], len(group)]))


#: Logits within this have exponentials whose sum single precision holds, without the largest being taken off first.
SAFE = 80.0
_ONES = np.ones((max(GROUPS, MEMBERS), 1), np.float32)


def _raised(z: np.ndarray, bound: float) -> np.ndarray:
    """The sums (a column) of the exponentials of each row of z, which these overwrite; rows beyond the bound are moved to below 0 first."""
    if not bound < SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ _ONES[: z.shape[1]]  # faster than sum()


def _surplus(z: np.ndarray, own: np.ndarray, n: int, bound: float = np.inf) -> np.ndarray:
    """The gradient of the loss, a mean over n rows, by the logits z (overwritten), none of which is beyond the bound."""
    sums = _raised(z, bound)
    sums *= n
    z /= sums
    z[np.arange(len(z)), own] -= 1 / n
    return z


def _log_own(z: np.ndarray, own: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """The log-probability of each row's own column by the logits z (overwritten), none of which is beyond the bound."""
    if not bound < SAFE:
        z -= z.max(axis=1, keepdims=True)
        bound = 0
    mine = z[np.arange(len(z)), own]
    return mine - np.log(_raised(z, bound)[:, 0])


def train(parts: DataFrame, rate: int = RATE, seed: int = 2) -> Network:
    """The network of sequences (key, part), trained in rounds by trainers whose weights are averaged; each round reads them anew."""
    n = parts.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0] // 2
    trainers = int(min(MOST_TRAINERS, max(1, -(-n // (rate * PER_TRAINER)))))
    # each trainer adds a row a weight, so that there must be no more of them than the input needs, whatever the session's partitions
    dealt = parts.repartition(trainers, "key", "part").coalesce(trainers).sortWithinPartitions("key", "part")
    model = Network.new(seed)
    whole = max(n, 1)
    for turn in range(ROUNDS if n else 0):
        start = model.dump()

        def run(batches, start=start, turn=turn):
            net, n = Network.new(seed).load(start), 0
            seen = net.squares()
            for rows in windows((x for batch in batches for x in batch.column(1).to_pylist()), rate, turn, ROUNDS):
                net.train(rows, seed + turn + n, seen=seen)
                n += len(rows)
            if n:
                flat = np.frombuffer(net.dump(), np.float32).astype(float)
                sums = np.append(np.rint(flat * (n / whole * UNIT)).astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["at", "part"])

        found = dealt.mapInArrow(run, "at int, part long").groupBy("at").agg(F.sum("part").alias("part")).toArrow()
        if not found.num_rows:
            continue
        sums = found.sort_by("at").column("part").to_numpy()
        model = model.load((sums[:-1] / (sums[-1] / whole * UNIT)).astype(np.float32).tobytes())
    return model


def score(rows: DataFrame, key: str, part: str, means: DataFrame, model: Network, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_tokens and log_likelihood of each whole text of classed() rows; means has the mean share (mean) of a key's words in their classes."""
    kept = rows.select(*keep)
    n_rare, mean = fresh(kept, "n_rare"), fresh(kept, "mean")
    schema = T.StructType([*kept.schema.fields, T.StructField(key, T.LongType()), T.StructField(n_rare, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])
    raw = model.dump()

    def run(batches):
        net = Network.new(0).load(raw)
        sides = net.sides()
        for batch in batches:
            for here in slices(batch):
                ds = [np.frombuffer(x, np.int16) for x in here.column(len(keep) + 1).to_pylist()]
                sizes = np.array([len(d) for d in ds])
                others = np.array([np.count_nonzero(d >= TOP) for d in ds])
                owner = np.repeat(np.arange(len(ds)), sizes)
                sums = np.bincount(owner, net.log_chance(*stream(ds), sides), minlength=len(ds)).astype(float)
                yield pa.RecordBatch.from_arrays([*here.columns[: len(keep) + 1], pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=schema.names)

    # rows that repeat an id and a text meet under one key: the mean is each one's own
    named = means.select(F.col("key").alias(key), F.col("mean").alias(mean))
    both = F.col("log_likelihood") + F.coalesce(F.col(n_rare) * F.col(mean), F.lit(0.0))
    return rows.select(*keep, key, part).mapInArrow(run, schema).join(named, key, "left").select(*keep, "n_tokens", both.alias("log_likelihood"))


def pseudo_likelihood(docs: DataFrame, keep: Sequence[str] = ("doc_id",), rate: int = RATE, seed: int = 2) -> DataFrame:
    """score() of docs by a network trained on them, and by their own counts of words. Words are looked up once, for training and scoring."""
    counted = cut(counts(docs))
    top = most(counted)
    key, part = fresh(docs.select(*keep), "key"), fresh(docs.select(*keep), "part")
    rows = cut(classed(docs, top, keep, key, part))
    model = train(rows.select(F.col(key).alias("key"), F.col(part).alias("part")).where("octet_length(part) > 0"), rate, seed)
    # words occur once in shares(), so that tasks get even and bounded parts of them, which needn't be sorted
    means = rare(docs, top).join(shares(counted, top).hint("shuffle_hash"), "word").groupBy("key").agg((F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("mean"))
    return score(rows, key, part, means, model, keep)
