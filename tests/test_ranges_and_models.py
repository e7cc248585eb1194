"""Ranges of paths and what is built on them: prediction, rollups, ranking, growing models, streams; stored boxes, quarantine."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from posetrie.config import DEFAULT, KEYPOINTS, PoseConfig
from posetrie.functions import octree, pose as P
from posetrie.operators import predict, quarantine, ranges, rank, train
from posetrie.sources import growing, model
from posetrie.sources.versions import Folder
from posetrie.streaming import training

D, W = DEFAULT.max_depth, DEFAULT.width


def paths(seed, n, deep=D * W):
    """Paths that share prefixes of many lengths."""
    r = random.Random(seed)
    base = ["".join(r.choice("01234567") for _ in range(deep)) for _ in range(max(2, n // 12))]
    out = []
    for _ in range(n):
        a = r.choice(base)
        k = r.randrange(deep + 1)
        out.append(a[:k] + "".join(r.choice("07") for _ in range(deep - k)) if r.random() < 0.6 else a)
    return out


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def plan_of(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_hold_what_their_bounds_say(spark):
    keys = paths(1, 3000)
    df = model.stored(table(spark, [(k,) for k in keys], "key string"))
    at = ranges.bounds(df, rows=100)
    assert 10 < len(at) <= 31 and at == sorted(at)
    got = df.select("key", ranges.number(F.col("key"), at).alias("r")).collect()
    assert all(x.r == sum(b <= x.key for b in at) for x in got)
    sizes = Counter(x.r for x in got)
    assert max(sizes.values()) < 12 * 100  # many of the keys are equal here
    assert ranges.bounds(df, rows=10**6) == [] and ranges.bounds(df.where("false")) == []


def tree_by_hand(rows):
    """{path: {label: n}} of (path, label)."""
    out = {"": Counter()}
    for path, label in rows:
        for n in range(0, len(path) + 1, W):
            out.setdefault(path[:n], Counter())[label] += 1
    return out


def resolved(counts):
    return max(counts.items(), key=lambda x: (x[1], x[0]))[0] if counts else None


def held(tree):
    return {r.node_path: (r.depth, r.total_samples, dict(r.sample_counts), r.resolved_label) for r in tree.collect()}


def wanted(rows):
    return {p: (len(p) // W, sum(c.values()), dict(c), resolved(c)) for p, c in tree_by_hand(rows).items()}


@pytest.mark.parametrize("rows", [7, 60, 10**6])
def test_rollups_in_any_ranges(spark, rows):
    r = random.Random(5)
    samples = [(p, r.choice("abc")) for p in paths(2, 900)]
    df = table(spark, samples, "path string, label string")
    want = wanted(samples)
    assert held(train.tree(df, rows=rows)) == want
    counts = train.counts(df, rows=rows)
    assert {(x.node_path, x.label): x.n for x in counts.collect()} == {(p, x): n for p, c in tree_by_hand(samples).items() for x, n in c.items()}
    assert counts.count() == sum(len(c) for c in tree_by_hand(samples).values())
    assert held(train.tree(df.where("false"), rows=rows)) == {"": (0, 0, {}, None)}


def test_a_rollup_shuffles_leaves_only(spark):
    """A third of all samples under one prefix: no range has several times its share, and nodes aren't shuffled."""
    hot = [("1" * 30 + p[:42], "a") for p in paths(3, 1500)] + [(p, "b") for p in paths(4, 3000)]
    df = model.stored(table(spark, hot, "path string, label string"))
    leaves = model.stored(train.leaf_counts(df))
    at = train.leaf_bounds(leaves, 100)
    sizes = [x["count"] for x in train.ranged(leaves, at).groupBy("range").count().collect()]
    assert max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]
    local = train.rolled_up(train.ranged(leaves, at), [], train.finished).drop("range")
    plan = plan_of(local).split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Generate" in plan


def predicted_by_hand(path, tree, fallback=True):
    if path is None or "" not in tree:
        return None, [], None, None
    steps = [""]
    while len(steps) <= D and path[: W * len(steps)] in tree and len(path) >= W * len(steps):
        steps.append(path[: W * len(steps)])
    labels = [tree[s][0] for s in steps]
    label = next((x for x in reversed(labels) if x is not None), None) if fallback else labels[-1]
    told = [(k, s[-W:] if k else None, tree[s][0], tree[s][1]) for k, s in enumerate(steps)]
    return label, told, len(steps) - 1, len(steps) - 1 < D


@pytest.mark.parametrize("rows, fallback", [(5, True), (40, False), (10**6, True)])
def test_predictions_by_brute_force(spark, rows, fallback):
    """Trees with gaps and blank labels, queries that are cut short, null or repeated very often."""
    r = random.Random(rows)
    known = {p: (r.choice(["a", "b", None]), r.randrange(9)) for p in tree_by_hand([(p, "x") for p in paths(6, 150)]) if r.random() > 0.03 or not p}
    nodes = model.stored(table(spark, [(len(p) // W, p, n, label) for p, (label, n) in known.items()], "depth int, node_path string, total_samples long, resolved_label string"))
    asked = [*paths(6, 200), *paths(7, 100), *[paths(6, 1)[0]] * 150, None, None, "", paths(6, 1)[0][:30]]
    queries = model.stored(table(spark, [(k, p, "s") for k, p in enumerate(asked)], "id int, path string, key string"))
    got = predict.predict(queries, nodes, PoseConfig(fallback="nearest_ancestor" if fallback else "none"), rows)
    found = {x.id: (x.predicted, [tuple(s) for s in x.steps], x.terminated_at_depth, x.fallback_triggered) for x in got.collect()}
    assert found == {k: predicted_by_hand(p, known, fallback) for k, p in enumerate(asked)}
    none = predict.predict(queries, nodes.where("false"), rows=rows).collect()
    assert len(none) == len(asked) and all((x.predicted, x.steps, x.terminated_at_depth, x.fallback_triggered) == (None, [], None, None) for x in none)


def test_a_prediction_is_one_sort(spark):
    nodes = model.stored(train.tree(table(spark, [(p, "x") for p in paths(8, 200)], "path string, label string")))
    queries = model.stored(table(spark, [(p,) for p in paths(8, 300)], "path string"))
    plan = plan_of(predict.predict(queries, nodes, rows=50).select("predicted")).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "SortMergeJoin" not in plan


def test_ranking_by_brute_force_with_any_weights(spark):
    r = random.Random(9)
    base = paths(10, 60)
    samples = [(k, r.choice(base)) for k in range(400)] + [(400 + k, base[0]) for k in range(200)] + [(700, None)]
    queries = [(k, p) for k, p in enumerate([*paths(11, 10), *base[:5], base[0], None, base[1][:30]])]
    for weight, k in ((lambda d: 1.0 / d, 4), (lambda d: 0.3 if d % 2 else 0.0, 7), (lambda d: 2.0**d, 1), (rank.halving, 700)):

        def far(a, b):
            total = 0.0
            for d in range(D):
                x, y = (z.ljust(72, "8")[d * W : d * W + W] for z in (a, b))
                total = total + weight(d + 1) * sum(i != j for i, j in zip(x, y))
            return total

        want = {(q, s, far(p, t), n) for q, p in queries if p is not None for n, (s, t) in enumerate(sorted(((s, t) for s, t in samples if t), key=lambda x: (far(p, x[1]), x[0]))[:k], 1)}
        got = rank.nearest_each(table(spark, queries, "query_id int, path string"), table(spark, samples, "pos int, path string"), k, weight=weight)
        assert {(x.query_id, x.pos, x.distance, x["rank"]) for x in got.collect()} == want


def test_few_queries_need_no_tries(spark, monkeypatch):
    r = random.Random(10)
    base = paths(12, 40)
    samples = table(spark, [(k, r.choice(base)) for k in range(300)] + [(300, None), (301, base[0][:12])], "pos int, path string")
    queries = table(spark, [(k, p) for k, p in enumerate([*paths(13, 4), *base[:3], base[0], None, base[1][:30]])], "query_id int, path string")
    by_tries = sorted(map(tuple, rank.nearest_each(queries, samples, 6, few=0).collect()))
    packed = samples.select("pos", *(c.alias(f"packed_{g}") for g, c in enumerate(rank.octree.packed_of(samples["path"]))))
    assert by_tries == sorted(map(tuple, rank.nearest_each(queries, packed, 6, few=0).collect()))
    monkeypatch.setattr(rank, "_nodes", None)
    for given in (samples, packed):
        assert sorted(map(tuple, rank.nearest_each(queries, given, 6).collect())) == by_tries
    every = rank.nearest_each(queries, samples, 1000, weight=lambda d: 0.0).groupBy("query_id").count().collect()
    assert {x["count"] for x in every} == {301}


def test_ranking_nothing(spark):
    some, none = table(spark, [(1, "1" * 72)], "query_id int, path string"), spark.createDataFrame([], "pos int, path string")
    assert rank.nearest_each(some, none).count() == 0
    assert rank.nearest_each(some.where("false"), some.withColumnRenamed("query_id", "pos")).count() == 0


def test_growing_models(spark, tmp_path):
    r = random.Random(12)
    first = [(p, r.choice("ab")) for p in paths(13, 800)]
    where = str(tmp_path / "m")
    made = growing.create(table(spark, first, "path string, label string"), where, rows=60)
    assert made.version == 0 and made.written > 8
    assert held(growing.load(spark, where)) == wanted(first)
    # a few leaves beside one another: all ranges but one or two stay, and the shared nodes are written
    near = sorted(p for p, _ in first)[100]
    more = [(near[:66] + f"{k:06o}", "c") for k in range(20)]
    change = growing.update(table(spark, more, "path string, label string"), where)
    assert change.version == 1 and change.written <= 4 and change.left >= made.written - 4
    assert held(growing.load(spark, where)) == wanted(first + more)
    assert held(growing.load(spark, where, 0)) == wanted(first)  # readers of the version before still have it
    last = [(p, "d") for p in paths(14, 200)]
    growing.update(table(spark, last, "path string, label string"), where)
    assert held(growing.load(spark, where)) == wanted(first + more + last)
    unchanged = growing.update(spark.createDataFrame([], "path string, label string"), where)
    assert (unchanged.version, unchanged.written) == (3, 0)
    assert held(growing.load(spark, where)) == wanted(first + more + last)
    with pytest.raises(FileExistsError):
        growing.create(spark.createDataFrame([], "path string, label string"), where)
    with pytest.raises(FileNotFoundError):
        growing.load(spark, str(tmp_path / "none"))


def test_recurring_paths_are_looked_up_once(spark, monkeypatch):
    nodes = model.stored(train.tree(table(spark, [(p, "ab"[k % 2]) for k, p in enumerate(paths(42, 300))], "path string, label string")))
    some = paths(42, 300)[:20] + paths(43, 20)
    asked = model.stored(table(spark, [(k, some[k % 40] if k % 9 else None) for k in range(900)] + [(k, some[3]) for k in range(900, 1500)], "id long, path string"))
    plain, seen = predict._looked_up, []
    wanted = sorted(map(str, plain(asked, nodes, predict.DEFAULT, 60).collect()))

    def counted(queries, *more):
        seen.append(queries.count())
        return plain(queries, *more)

    monkeypatch.setattr(predict, "_looked_up", counted)
    assert sorted(map(str, predict.predict(asked, nodes, rows=60).collect())) == wanted
    assert seen == [len(set(some))]


def test_poses_go_down_in_one_shuffle(spark, monkeypatch):
    r = random.Random(44)
    rows = [(k, *(None if r.random() < 0.02 else r.uniform(-99, 99) if r.random() < 0.3 else 1.0 for _ in range(18))) for k in range(600)]
    flat = table(spark, rows, "id long, " + ", ".join(f"c{i} double" for i in range(18)))
    pose = F.struct(*(F.struct(*(F.col(f"c{3 * i + a}").alias(x) for a, x in enumerate("xyz"))).alias(k) for i, k in enumerate(predict.DEFAULT.keypoints)))
    poses = model.stored(flat.select("id", F.when(F.col("id") % 50 != 0, pose).alias("pose")))
    learned = octree.with_path(poses.where("pose IS NOT NULL AND id % 3 = 0"), "pose")
    nodes = model.stored(train.tree(learned.select("path", F.col("id").cast("string").alias("label"))).where("node_path NOT LIKE '7%' OR depth <> 5"))
    of_paths = predict.predict(model.stored(octree.with_path(poses.where("pose IS NOT NULL"), "pose")), nodes).drop("path")
    wanted = sorted(map(str, of_paths.collect()))
    stores = []
    stored = model.stored
    monkeypatch.setattr(model, "stored", lambda df, what="table", by=None: stores.append(what) or stored(df, what, by))
    for crowd in (predict.CROWD, 1):
        monkeypatch.setattr(predict, "CROWD", crowd)
        for most, block in ((20_000, 100_000), (5, 100_000), (0, 100_000), (5, 20)):
            got = predict.descend(poses, "pose", nodes, most_broadcast=most, block=block)
            rows = got.collect()
            assert sorted(str(x) for x in rows if x["pose"] is not None) == wanted
            assert {(x["predicted"], len(x["steps"]), x["terminated_at_depth"]) for x in rows if x["pose"] is None} == {(None, 0, None)}
            if block > 20:
                assert "descent" not in stores  # no level is written any more


def test_an_update_writes_a_range_as_one_small_file(spark, tmp_path):
    where = str(tmp_path / "m")
    growing.create(table(spark, [(p, "a") for p in paths(40, 400)], "path string, label string"), where, rows=60)
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with parts too large to be joined
    try:
        growing.update(table(spark, [(p, "b") for p in paths(41, 400)], "path string, label string"), where)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    folders = list((tmp_path / "m" / "data" / "1").glob("range=*"))
    files = [f for folder in folders for f in folder.glob("*.parquet")]
    assert len(folders) > 5 and len(files) == len(folders)
    assert max(f.stat().st_size for version in "01" for f in (tmp_path / "m" / "data" / version).glob("*/*.parquet")) < 256 << 10


def scanned(df):
    """Rows that the Parquet scans of a query gave, before any filter."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if "Scan parquet" in node.nodeName():
            found += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def test_few_queries_read_few_row_groups(spark, tmp_path):
    samples = [(p, "a") for p in paths(15, 4000)]
    where = str(tmp_path / "m")
    growing.create(table(spark, samples, "path string, label string"), where, rows=500, row_group=16 << 10)
    asked = model.stored(table(spark, [(samples[k][0],) for k in (5, 1000)] + [("7" * 72,)], "path string"))
    near = growing.near(asked, where)
    everything = growing.load(spark, where)
    assert scanned(near) < 0.2 * scanned(everything)
    got = predict.predict(asked, model.stored(near))
    want = predict.predict(asked, model.stored(everything))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    many = model.stored(table(spark, [(p,) for p in paths(16, 500)], "path string"))
    both = [predict.predict(many, model.stored(n)) for n in (growing.near(many, where), everything)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_a_stream_keeps_few_runs(spark, tmp_path):
    where, seen = str(tmp_path / "s"), []
    for number in range(11):
        rows = [(p, "abc"[number % 3]) for p in paths(20 + number, 20)]
        seen += rows
        training.add(table(spark, rows, "path string, label string"), number, where, fanout=2)
        assert len(training.runs(spark, where)) <= 1 + math.log2(number + 1)
    assert held(train.nodes(training.counts(spark, where))) == wanted(seen)
    before = training.runs(spark, where)
    training.add(table(spark, [("1" * 72, "z")], "path string, label string"), 10, where, fanout=2)
    assert training.runs(spark, where) == before  # a batch that is there already
    store = Folder(spark, where)
    assert len(store.numbers()) == training.KEPT
    live = {r["name"] for n in store.numbers() for r in store.read(n)["runs"]}
    assert {f.name for f in (tmp_path / "s" / "runs").iterdir()} >= live


def test_a_batch_that_was_broken_off_is_written_anew(spark, tmp_path):
    where, one, two = str(tmp_path / "s"), [("1" * 72, "a")], [("2" * 72, "b")]
    training.add(table(spark, one, "path string, label string"), 0, where)
    train.counts(table(spark, [("3" * 72, "c")], "path string, label string")).write.parquet(f"{where}/runs/1-1")  # no version tells of it
    assert held(train.nodes(training.counts(spark, where))) == wanted(one)
    training.add(table(spark, two, "path string, label string"), 1, where)
    assert held(train.nodes(training.counts(spark, where))) == wanted(one + two)
    assert training.counts(spark, str(tmp_path / "none")).count() == 0


def test_a_version_is_made_once(spark, tmp_path):
    store = Folder(spark, str(tmp_path))
    store.commit(3, {"a": 1})
    with pytest.raises(FileExistsError):
        store.commit(3, {"a": 2})
    store.commit(11, {"a": 5})
    assert store.numbers() == [3, 11] and store.latest() == {"a": 5} and store.read(3) == {"a": 1}


def upper(x, low, high):
    return not math.isnan(x) and x >= (low + high) / 2


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_descent_in_stored_boxes(spark, most):
    """Nodes whose boxes are anything at all, by hand."""
    r = random.Random(most)
    poses = [tuple(r.choice([r.uniform(-120, 120), float(r.randrange(-100, 101, 25)), math.nan]) for _ in range(18)) for _ in range(60)] + [None, None]
    boxes, known = {}, {}

    def box():
        low = [r.uniform(-100, 0) for _ in range(3)]
        return low, [x + r.uniform(1, 150) for x in low]

    def code(point, at):
        return "".join(str(sum(upper(point[3 * k + a], at[k][0][a], at[k][1][a]) << a for a in range(3))) for k in range(W))

    for i, point in enumerate(poses[:45]):  # the nodes on most poses' ways down, some not to the end
        path = ""
        for _ in range(r.choice([D, D, 5]) + 1):
            boxes.setdefault(path, [box() for _ in range(W)])
            known.setdefault(path, (r.choice(["a", None]), i))
            path += code(point, boxes[path])
            if len(path) > D * W:
                break
    rows = [(len(p) // W, p, known[p][1], known[p][0], [{end: dict(zip("xyz", c)) for end, c in zip(("min", "max"), b)} for b in boxes[p]]) for p in known]
    nodes = model.stored(spark.createDataFrame(rows, f"depth int, node_path string, total_samples long, resolved_label string, boxes {model.BOXES.simpleString()}"))
    asked = spark.createDataFrame([(i, None if p is None else {k: dict(zip("xyz", p[3 * n : 3 * n + 3])) for n, k in enumerate(KEYPOINTS)}) for i, p in enumerate(poses)], "id int, pose struct<" + ",".join(f"{k}:{P.VECTOR.simpleString()}" for k in KEYPOINTS) + ">")
    assert not model.boxes_follow(nodes)
    got = {x.id: x for x in (predict.descend(asked, "pose", nodes, most_broadcast=most) if most < 10**6 else predict.predict_poses(asked, "pose", nodes)).collect()}
    for i, point in enumerate(poses):
        path, steps = "", []
        while point is not None and path in known and len(path) <= D * W:
            steps.append((len(path) // W, path[-W:] or None, *known[path]))
            path += code(point, boxes[path])
        want = [x[2] for x in steps if x[2] is not None]
        x = got[i]
        assert [tuple(s) for s in x.steps] == steps
        assert (x.predicted, x.terminated_at_depth, x.fallback_triggered) == (want[-1] if want else None, len(steps) - 1 if steps else None, len(steps) - 1 < D if steps else None)


def test_boxes_on_disk(spark, tmp_path):
    tree = model.stored(train.tree(spark.createDataFrame([("1" * 72, "a"), ("2" * 72, "b")], "path string, label string")))
    boxed = tree.withColumn("boxes", model.path_boxes(F.col("node_path")))
    assert model.boxes_follow(tree) and model.boxes_follow(boxed)
    moved = boxed.withColumn("boxes", F.when(F.col("depth") == 3, F.reverse("boxes")).otherwise(F.col("boxes")))
    moved = moved.withColumn("boxes", F.transform("boxes", lambda b: b.withField("max", b["max"].withField("x", b["max"]["x"] + 1))))
    assert not model.boxes_follow(moved)
    model.save(moved, str(tmp_path / "m"))
    model.save(tree, str(tmp_path / "m"), "plain")
    in_order = lambda df: sorted(map(str, df.select("node_path", "boxes").collect()))
    assert in_order(model.load(spark, str(tmp_path / "m"), boxes=True)) == in_order(moved)
    assert {x.boxes for x in model.load(spark, str(tmp_path / "m"), "plain", boxes=True).collect()} == {None}
    model.write_json(moved, str(tmp_path / "j"))
    assert in_order(model.read_json(spark, str(tmp_path / "j"))) == in_order(moved)
    with pytest.raises(FileNotFoundError, match="no model other"):
        model.load(spark, str(tmp_path / "m"), "other")


def test_quarantine(spark):
    good = {k: [1.0 * i, 2.0, 3.0] for i, k in enumerate(KEYPOINTS)}
    rows = [
        good,
        good | {"tail": None},
        {k: v for k, v in good.items() if k != "neck"},
        good | {"neck": [1.0], "hips": None},
        {k: v for k, v in good.items() if k not in ("hips", "neck")} | {"left_wrist": []},
        None,
        {},
        good | {"neck": [None, 1.0, 2.0]},
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, kp map<string,array<double>>")
    found = quarantine.sort_out(df, "kp")
    assert {x.id for x in found.good.collect()} == {0, 1, 7}
    assert {x.id: x.reasons for x in found.rejected.collect()} == {
        2: ["no neck"],
        3: ["hips: expected 3 values, got null", "neck: expected 3 values, got 1"],
        4: ["no hips", "left_wrist: expected 3 values, got 0", "no neck"],
        5: ["no keypoints"],
        6: [f"no {k}" for k in KEYPOINTS],
    }
    assert found.counts == {"total": 8, "good": 3, "rejected": 5, "no_map": 1, "missing_name": 3, "wrong_arity": 2}
    assert found.good.where("id = 0").first()["pose"]["neck"]["x"] == 3.0
    empty = quarantine.sort_out(df.where("false"), "kp")
    assert empty.good.count() == empty.rejected.count() == empty.counts["total"] == 0
    with pytest.raises(ValueError, match="pose"):
        quarantine.sort_out(df.withColumn("Pose", F.lit(1)), "kp")
    with pytest.raises(Exception, match="missing keypoints"):
        df.where("id = 5").select(P.coerce(df, "kp")).collect()
