"""A quality classifier from overlapping heuristic labellers.

Labellers vote on the figures of a document (see quality); expectation-maximisation estimates their
accuracies from all documents' votes (see labelmodel), and the posterior probabilities are the labels
of a hashed linear scorer: logistic regression on the hashed words and word shapes of the whole text
and on its figures in steps. The scorer is fitted on a bounded sample, the TRAIN_ROWS documents at
most whose hash of id and text is below a threshold; the label model and the scores cover all documents.

Null and empty texts have the figures' features alone. Ties and repeated rows have equal results; rows
that repeat an id are each scored. An empty table is scored by an untrained model, to no rows. Columns
not in keep go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from posetrie.llm import labelmodel, quality
from posetrie.llm.common import cut, slices

DIM = 1 << 15
#: The bound of the labelled sample that the scorer is fitted on; about two kilobytes a row where it is fitted.
TRAIN_ROWS = 20_000
EPOCHS, BATCH = 4, 64
_SHAPE = bytes(b"a"[0] if 97 <= k <= 122 or k >= 128 else b"A"[0] if 65 <= k <= 90 else b"0"[0] if 48 <= k <= 57 else k for k in range(256))
_STEPS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.8)


def shape(word: bytes) -> bytes:
    """A shaped word with every run of a character cut to two."""
    out = word[:2]
    for k in range(2, len(word)):
        if word[k] != word[k - 1] or word[k] != word[k - 2]:
            out += word[k : k + 1]
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text's features: shares of words and shapes, and 1 for the step of each figure."""
    text = text or ""
    raw = text.encode()
    words = Counter(raw.lower().split())
    shapes: Counter = Counter()
    for w, n in Counter(raw.translate(_SHAPE).split()).items():
        shapes[shape(w)] += n
    f = dict(zip(quality.FIGURES, quality.figures(text)))
    n, lines = max(f["n_words"], 1), max(f["n_lines"], 1)
    ratios = {
        "symbols": f["n_symbols"] / n,
        "dup": f["n_dup_lines"] / lines,
        "again": f["n_repeat_words"] / n,
        "shout": f["n_upper"] / max(f["n_letters"], 1),
        "bare": f["n_bare"] / n,
        "ended": f["n_ended_lines"] / lines,
    }
    steps = [f"{k}>{s}".encode() for k, x in ratios.items() for s in _STEPS if x > s] + [b"words>%d" % s for s in (5, 20, 50, 100) if f["n_words"] > s] + [b"1"]
    h = xxhash.xxh32_intdigest
    at = [h(w, 1) for w in words] + [h(s, 2) for s in shapes] + [h(s, 3) for s in steps]
    value = [c / n for c in words.values()] + [c / n for c in shapes.values()] + [0.3] * len(steps)
    return np.array(at, np.int64) % DIM, np.array(value, np.float64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, seed: int, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression on soft labels p, by AdaGrad; both classes weigh the same."""
    w, seen = np.zeros(DIM), np.full(DIM, 1e-3)
    if not len(rows):
        return w
    good = float(np.clip(p.mean(), 0.02, 0.98))
    weight = p / good + (1 - p) / (1 - good)
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            at = np.concatenate([rows[k][0] for k in some])
            x = np.concatenate([rows[k][1] for k in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            z = np.bincount(owner, x * w[at], minlength=len(some))
            # the labels' odds of either class count alike
            y = p[some] / good / weight[some]
            err = (1 / (1 + np.exp(-z)) - y) * weight[some] / len(some)
            g = np.bincount(at, err[owner] * x, minlength=DIM)
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def train(docs: DataFrame, most: int = TRAIN_ROWS, seed: int = 7) -> tuple[np.ndarray, labelmodel.LabelModel]:
    """The scorer's weights and the label model of docs (doc_id, text)."""
    figured = quality.with_figures(docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")), "text", "f")
    voted = cut(figured.select("doc_id", "h", labelmodel.code(quality.votes("f")).alias("votes")))
    model, posterior = labelmodel.fit_codes(voted, "votes", quality.N_RULES)
    n = voted.count()
    # a hash threshold that leaves some most rows, then the lowest hashes of them
    share = min(1.0, 1.2 * most / max(n, 1))
    below = F.pmod(F.col("h"), F.lit(1 << 40)) < int(share * (1 << 40))
    labelled = voted.where(below).orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "doc_id").limit(most).join(F.broadcast(posterior), "votes").select("doc_id", "h", "p_good")
    labelled = cut(labelled.dropDuplicates(["h"]))
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).where(below)
    sample = hashed.join(labelled.drop("doc_id"), "h").dropDuplicates(["h"]).select("h", "text", "p_good")

    def run(batches):
        rows, p, h = [], [], []
        for batch in batches:
            rows += [features(x) for x in batch.column(1).to_pylist()]
            p += batch.column(2).to_pylist()
            h += batch.column(0).to_pylist()
        order = np.argsort(np.array(h, np.int64), kind="stable")
        w = fit([rows[k] for k in order], np.array(p, float)[order], seed)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    found = sample.coalesce(1).mapInArrow(run, "w binary").collect()
    return np.frombuffer(bytes(found[0][0])) if found else np.zeros(DIM), model


def score(docs: DataFrame, weights: np.ndarray, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep and p_quality of each whole text."""
    rows = docs.select(*keep, "text")
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("p_quality", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                z = np.array([float(v @ weights[at]) for at, v in map(features, part.column(len(keep)).to_pylist())])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return rows.mapInArrow(run, schema)
