"""How many Python workers a task takes, and what these do once."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from posetrie.llm import bpe, pseudolm, queries


def test_round_trip_takes_one_worker(spark):
    """Ids and bytes are those of encode() and then decode(), from one step of Python: two in a row would keep two workers a task."""
    texts = [None, "", "two  words\n", "naïve 😀 \x1c text", "a" * 70_000 + " b"]
    docs = spark.createDataFrame([(i, x, -i) for i, x in enumerate(texts)], "doc_id long, text string, more int")
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    apart = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).drop("text")
    together = bpe.round_trip(docs, ranks, pattern)
    assert together.columns == apart.columns and sorted(together.collect()) == sorted(apart.collect())
    plan = queries.bpe_digest(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_words_are_looked_up_once_a_batch():
    """Classes by Arrow are those of words(), text by text, and an update without a class's row leaves its embedding and its state as they were."""
    r = np.random.default_rng(5)
    texts = [None, "", "  \x0b", " A b\tb\x1cB\x85 \xa0c ", *(" ".join(f"W{k}" for k in r.integers(50, size=n)) for n in (1, 9, 300))]
    top = [b"w3", b"b", b"w7"]
    place = {w: k for k, w in enumerate(top)}
    want = [[place.get(w, pseudolm.TOP + zlib.crc32(w) % pseudolm.OTHER) for w in pseudolm.words(x)] for x in texts]
    found = pseudolm.Vocabulary(top)
    assert [x.tolist() for x in found.classes(pa.array(["x", *texts]).slice(1))] == want
    assert [x.tolist() for x in found.classes(pa.array(texts[:3], pa.string()))] == [[], [], []] and found.classes(pa.array([], pa.string())) == []
    counted, sizes = pseudolm.split(pa.array(texts))
    assert sizes.tolist() == list(map(len, want)) and len(counted) == sum(sizes)
    net = pseudolm.Network.new(3)
    seen, before = net.squares(), {k: x.copy() for k, x in net.p.items()}
    net.train(r.integers(100, size=(300, 2 * pseudolm.SIDE + 1)).astype(np.int16), 1, seen=seen)
    assert (net.p["e"][100:] == before["e"][100:]).all() and (seen["e"][100:] == np.float32(1e-4)).all() and (net.p["e"][:100] != before["e"][:100]).any(axis=1).all()


def test_logits_beyond_what_exponentials_hold():
    """Where the bound tells that no logit is too large, none is taken off first; where it doesn't, results don't overflow."""
    own = np.arange(4)
    for size in (1.0, 79.0, 500.0):
        z = (np.random.default_rng(1).uniform(-size, size, (4, 64))).astype(np.float32)
        exact = z.astype(float) - z.max(axis=1, keepdims=True)
        p = np.exp(exact) / np.exp(exact).sum(axis=1, keepdims=True)
        assert np.allclose(pseudolm._log_own(z.copy(), own, size), (exact - np.log(np.exp(exact).sum(axis=1, keepdims=True)))[own, own], atol=1e-3, rtol=1e-5)
        p[own, own] -= 1
        assert np.allclose(pseudolm._surplus(z.copy(), own, 4, size), p / 4, atol=1e-6)


def test_texts_are_looked_up_by_one_step(spark):
    """Training and scoring read the same stored classes: besides counting, looking up, training and rare words, scoring is the only step of Python, and it reads no text."""
    docs = spark.createDataFrame([(k, f"a b c{k}") for k in range(20)], "doc_id long, text string")
    plan = pseudolm.pseudo_likelihood(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    scoring = next(x for x in plan.splitlines() if "MapInArrow" in x and "log_likelihood" in x)
    assert "text" not in scoring
