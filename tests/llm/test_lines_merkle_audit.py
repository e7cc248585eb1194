"""Line dedup, Merkle manifest and filter audit against brute force, with nulls, repeats, ties and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrie.llm import audit, lines, merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, row string, n_dropped long, kept string"
SHARED = "Permission is granted to copy THIS line as often as you like"
UMLAUT = "ÄÖÜ " + SHARED
TEXTS = [
    None,
    "",
    "\n",
    " \t \n\n",
    SHARED,
    f"  {SHARED}\t",
    f"\v{SHARED.lower()}\f\r",
    f"one\n{SHARED}\ntwo\n{SHARED.upper()}\n",
    f"{SHARED} ",
    f"{UMLAUT}\nq",
    UMLAUT.replace("T", "t"),
    UMLAUT.lower(),
    "short\nshort\nshort",
    "\n".join(f"line number {k} of a very long text, which has many of them" for k in range(4000)),
    "\n".join(f"line number {k} of a very long text, which has many of them" for k in range(0, 4000, 2)),
    "word " * 60,
    " ".join(f"w{k}" for k in range(70)) + " # end",
    " ".join(f"w{k}" for k in range(70)),
    "A B C " * 30,
]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = []
    for i in range(140):
        text = TEXTS[i % len(TEXTS)]
        out.append((i * 7 % 1000 if i % 9 else None, text, [None, "en"][i % 2], [None, "", "b", "a", "ä", "b"][int(r.integers(6))], None if i % 5 == 0 else i, -1, "r", -2, "k"))
    out += [out[20]] * 40 + [(out[21][0], *out[22][1:])] * 3  # repeated rows, and several texts of one id
    out += [(5000 + k, f"{k}", "en", "hot", k, 0, "", 0, "") for k in range(600)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def sf(spark, rows, docs, tmp_path_factory):
    """A folder with the rows as documents, and labels that repeat."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 3 and i % 2, None if i % 5 == 0 else i % 7 == 0) for i in range(0, 900)] + [(7, 1, True), (7, 0, False), (None, 1, True)]
    spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def stripped(line):
    key = line.strip(" \t\n\v\f\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def lines_by_hand(rows, chars=40, documents=5):
    held = defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            held[stripped(line)].add(-1 if row[0] is None else row[0])
    last = {key: max(ids) for key, ids in held.items() if len(key) >= chars and len(ids) >= documents}
    out = []
    for row in rows:
        every = (row[1] or "").split("\n")
        kept = [x for x in every if last.get(stripped(x), (i := -1 if row[0] is None else row[0])) == (-1 if row[0] is None else row[0])]
        out.append((row[0], len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_query(spark, rows, sf):
    got = queries.op11_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    want = lines_by_hand(rows)
    assert Counter(map(tuple, got)) == want
    assert any(x[2] for x in want) and any(x[2] > 1000 for x in want)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (7, 2), (5, 3)])
def test_line_dedup_in_any_batches(spark, rows, docs, batches, fanout):
    got = lines.dedup(docs, 12, 3, batches, fanout)
    assert got.select("doc.*").columns == docs.columns
    digested = got.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256))
    assert Counter(map(tuple, digested.collect())) == lines_by_hand(rows, 12, 3)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("posetrie_run")]


def test_runs_hold_a_key_once(spark):
    runs = lines.Runs(spark, fanout=2)
    parts = [[(k, -k, 1, 10 * b + k) for k in range(b, b + 6)] for b in range(7)]
    for part in parts:
        runs.add(spark.createDataFrame(part, "h1 long, h2 long, n long, last long"))
    keys = [r.h1 for name in runs.runs() for r in spark.table(name).collect()]
    assert sorted(keys) == list(range(12))
    assert len(runs.runs()) <= 4  # seven batches of fanout 2: levels of at most one run each
    plan = spark.table(runs.runs()[0]).join(spark.table(runs.runs()[-1]).hint("merge"), lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = {r.h1: r.last for r in runs.frequent(3).collect()}
    held = Counter(k for part in parts for k, *_ in part)
    assert found == {k: max(x[3] for part in parts for x in part if x[0] == k) for k, n in held.items() if n >= 3}
    runs.close()


def test_pieces_between_dropped_lines(spark):
    cases = [([], "abc"), ([0], "bc"), ([2], "ab"), ([0, 1, 2], ""), ([1], "ac")]
    for gone, want in cases:
        got = spark.range(1).select(F.array_join(lines.without(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, gone)).cast("array<int>")), "")).first()[0]
        assert got == want


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(digests):
    """(root, path of each leaf: its siblings to the left and right, level by level)."""
    level, at, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            paths[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[k] = place // 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def merkle_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        groups[source].append((doc_id, leaf_by_hand(doc_id, source, lang, n_chars, text), leaf_by_hand(doc_id, source, lang, n_chars, lowered if tampered else text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree_by_hand([x[1] for x in groups[name]])
    root, tops = tree_by_hand([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for (doc_id, leaf, other), path in zip(groups[name], trees[name][1]):
            whole = path + top
            fold = other
            for left, right in whole:
                fold = sha(left + fold + right)
            out.append((doc_id, leaf, trees[name][0], root, sha("".join(a + b for a, b in whole)), fold, fold == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle_query(spark, rows, sf):
    got = Counter(map(tuple, queries.op12_merkle_manifest(spark, sf).select(*COLUMNS).collect()))
    want = merkle_by_hand(rows)
    assert got == want
    assert {x[6] for x in want} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (40, 40), (300, 2)])
def test_merkle_of_any_size(spark, n, sources):
    held = [(i, sha(f"{i}"), f"s{i % sources}") for i in range(n)]
    found = merkle.manifest(spark.createDataFrame(held, "doc_id long, leaf string, source string"), "source", ["doc_id"])
    names = sorted({x[2] for x in held})
    trees = {s: tree_by_hand([x[1] for x in held if x[2] == s])[0] for s in names}
    assert found.root == tree_by_hand([trees[s] for s in names])[0]
    rows = found.rows.select("source", "subroot", merkle.folded(F.col("path"), F.col("leaf")).alias("fold")).collect()
    assert len(rows) == n and all(r.fold == found.root and r.subroot == trees[r.source] for r in rows)


def test_merkle_refuses_clashing_names(spark):
    with pytest.raises(ValueError, match="idx, path"):
        merkle.manifest(spark.range(1).selectExpr("id AS doc_id", "'a' AS source", "'x' AS leaf", "1 AS idx", "2 AS Path"), "source", ["doc_id"])


def masks_by_hand(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _, source, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > first[t]]
        yield doc_id, source or "", {f for f, x in zip("ABCDE", fails) if x}


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, part, fails in masks_by_hand(rows):
        parts[part].append((doc_id, fails))
    out, removed_by = {}, Counter()
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before, upto = set(order[: step - 1]), set(order[:step])
                gone = [i for i, x in held if f in x and not x & before]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    sum(not x & upto for _, x in held), len(gone), sum(f in x and bool(x & before) for _, x in held), sum(x == {f} for _, x in held),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                )
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_query(spark, rows, sf):
    got = queries.op13_filter_audit(spark, sf)
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = audit_by_hand(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == want
    assert all(any(v[k] for v in want.values()) for k in range(7))


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert lines.dedup(none).count() == 0
    found = merkle.manifest(none.select("doc_id", "source", F.col("text").alias("leaf")), "source", ["doc_id"])
    assert found.root is None and found.rows.count() == 0
    assert audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


def test_shares_of_a_hot_text_and_id_are_split(spark):
    """A text that a third of all rows share, and an id, come out in one row a cell; no pair is made."""
    hot = spark.range(30000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' WHEN id % 3 = 1 THEN concat('t', id) END AS text", "'s' AS source")
    held = audit.cells(hot, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.mask: r.n for r in held} == {1: 10002, 1 | 16: 19998}
