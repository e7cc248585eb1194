"""Goldens, properties and round trips of the pose index."""

import math

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from posetrie.config import DEFAULT, KEYPOINTS, PoseConfig
from posetrie.functions import octree, pose as P, rotation
from posetrie.operators import evaluate, predict, rank, train
from posetrie.sources import bvh, clips, metadata, model
from posetrie.streaming import training

INF, NAN = math.inf, math.nan


def halved(x, low=-100.0, high=100.0, depth=12):
    k = 0
    for _ in range(depth):
        middle = (low + high) / 2
        bit = x >= middle
        low, high = (middle, high) if bit else (low, middle)
        k = 2 * k + bit
    return k


def edge_points():
    points = [150.0, -150.0, INF, -INF, NAN, 0.0, -0.0, -1e-17, 100.0, -100.0]
    for k in range(4097):
        e = (25 * k - 51200) / 512
        points += [e, math.nextafter(e, INF), math.nextafter(e, -INF)]
    return points


def test_cells_are_exact_at_every_edge(spark):
    points = edge_points()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "i int, x double")
    got = rows.select("i", octree.cell(F.col("x")).alias("c"), octree.cell_by_halving(F.col("x"), -100, 100, 12).alias("h")).collect()
    for r in got:
        assert r.c == r.h == halved(points[r.i]), points[r.i]


@pytest.mark.parametrize("point, want", [((0, 0, 0), 7), ((-0.0, -0.0, -0.0), 7), ((-1e-17, 0, 0), 6), ((NAN, 1, -1), 2), ((150, -150, 50), 5), ((-INF, INF, -1), 2)])
def test_octants_at_the_root(spark, point, want):
    root = octree.box((-100,) * 3, (100,) * 3)
    p = P.vector(*(F.lit(float(x)) for x in point))
    assert spark.range(1).select(octree.octant(p, root)).first()[0] == want


@pytest.mark.parametrize("o, low, high", [(0, (-100, -100, -100), (0, 0, 0)), (1, (0, -100, -100), (100, 0, 0)), (2, (-100, 0, -100), (0, 100, 0)), (5, (0, -100, 0), (100, 0, 100)), (7, (0, 0, 0), (100, 100, 100))])
def test_parts_of_a_box(spark, o, low, high):
    b = spark.range(1).select(octree.box_values(octree.subdivide(octree.box((-100,) * 3, (100,) * 3), F.lit(o)))).first()[0]
    assert b == [list(map(float, low)), list(map(float, high))]


@pytest.mark.parametrize("o", [-1, 8])
def test_octants_out_of_range_are_errors(spark, o):
    with pytest.raises(Exception, match="octant out of"):
        spark.range(1).select(octree.subdivide(octree.box((-1,) * 3, (1,) * 3), F.lit(o))).collect()


def test_codes_and_keys(spark):
    row = spark.range(1).select(
        octree.code(F.array(*map(F.lit, (2, 2, 7, 3, 0, 4)))).alias("c"), octree.child_key(F.lit("227304")).alias("k"), octree.code_of_key(F.lit(" 2, 2,7,,3,0 ,4")).alias("b"), octree.octants(F.lit("227304")).alias("o")
    ).first()
    assert (row.c, row.k, row.b, row.o) == ("227304", "2,2,7,3,0,4", "227304", [2, 2, 7, 3, 0, 4])


#: Keypoints of a walking clip's first frame, with stack parents and with nesting parents, and their codes.
FRAME = {
    "compat": ({"left_wrist": (11.702327, 1.814764, -0.31476), "right_wrist": (-11.807161, -0.407834, -0.32616)}, "730354 047423 047423 047401 056423 056601 076423 046610 055476 033255 013422 076402"),
    "strict": ({"left_wrist": (11.712537, 3.879124, -0.37397), "right_wrist": (-11.777341, 3.711026, -0.52649)}, "732354 045423 045423 045401 054423 076601 054423 044610 073476 037255 031422 034402"),
}
REST = {"hips": (0.0, 0.0, 0.0), "neck": (0.02982, 4.11886, -0.20033), "left_ankle": (1.39703, -16.68144, 0.62477), "right_ankle": (-1.352348, -16.603285, 0.62476)}


def as_pose(at):
    return F.struct(*(P.vector(*map(float, at[k])).alias(k) for k in KEYPOINTS))


@pytest.mark.parametrize("mode", FRAME)
def test_paths_of_known_poses(spark, mode):
    at, codes = FRAME[mode]
    df = octree.with_path(spark.range(1).select(as_pose(REST | at).alias("pose")), "pose")
    assert df.select(octree.codes(F.col("path"))).first()[0] == codes.split()


coordinate = st.floats(-130, 130, allow_nan=False, width=64)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[coordinate] * 18), min_size=1, max_size=8))
def test_paths_by_both_ways(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} double" for k in range(18)))
    p = F.struct(*(P.vector(*(F.col(f"c{3 * k + j}") for j in range(3))).alias(n) for k, n in enumerate(KEYPOINTS)))
    posed = df.select("i", p.alias("pose"))
    other = PoseConfig(boxes={k: ((-100.0, -100.0, -100.0), (100.0, 100.0, 100.0 + 1e-300)) for k in KEYPOINTS}, half=100.0)
    closed = dict(octree.with_path(posed, "pose").select("i", "path").collect())
    folded = dict(octree.with_path(posed, "pose", config=other).select("i", "path").collect())
    for i, r in enumerate(rows):
        k = [halved(x) for x in r]
        want = "".join(str(sum((k[3 * n + a] >> (11 - d) & 1) << a for a in range(3))) for d in range(12) for n in range(6))
        assert closed[i] == folded[i] == want


def test_boxes_of_paths(spark):
    path = "012345" * 3
    for k in range(6):
        b = octree.box_of_path(F.lit(path), k)
        fold = octree.box_of_path(F.lit(path), k, ((-100.0,) * 3, (100.0, 100.0, 100.0 + 1e-13)))
        got, other = spark.range(1).select(octree.box_values(b), octree.box_values(fold)).first()
        assert all(abs(x - y) < 1e-9 for p, q in zip(got, other) for x, y in zip(p, q))


def test_codes_of_another_length_are_errors(spark):
    for bad in (octree.code(F.array(F.lit(1), F.lit(2))), octree.code_of_key(F.lit("1,2,3,4,5,6,7")), octree.code(F.array(*map(F.lit, (1, 2, 3, 4, 5, 8))))):
        with pytest.raises(Exception, match="expected 6 octants"):
            spark.range(1).select(bad).collect()


def test_null_coordinates_count_as_nan(spark):
    at = {k: [F.lit(float("nan")) if k == "neck" else F.lit(1.0)] * 3 for k in KEYPOINTS}
    nan = octree.with_path(spark.range(1), at).first().path
    lost = octree.with_path(spark.range(1), at | {"neck": [F.lit(None).cast("double")] * 3}).first().path
    assert nan == lost and nan[3] == "0"


def test_prediction_in_any_ranges(spark):
    tree = train.nodes(train.counts(samples(spark, (P1, "walk"), (P2, "run"), (P3, "run"))))
    asked = samples(spark, (P1, "a"), (P2, "b"), ("1" * 66 + "222222", "c"), ("4" * 72, "d"))
    key = lambda df: sorted((r.path, r.predicted, r.terminated_at_depth, len(r.steps)) for r in df.collect())
    whole = key(predict.predict(asked, tree))
    assert [x[2] for x in whole] == [12, 11, 12, 0]
    assert all(key(predict.predict(asked, tree, rows=n)) == whole for n in (1, 2, 5, 11))


def test_nearest_of_each_by_brute_force(spark):
    import random

    r = random.Random(3)
    path = lambda: "".join(r.choice("01") for _ in range(72))
    base = [path() for _ in range(40)]
    held, asked = [(k, r.choice(base)) for k in range(300)], [(k, path()) for k in range(12)]
    far = lambda a, b: sum(2.0 ** -(1 + i // 6) for i in range(72) if a[i] != b[i])
    want = [(q, *x) for q, p in asked for x in ((s, far(p, t), k + 1) for k, (s, t) in enumerate(sorted(held, key=lambda x: (far(p, x[1]), x[0]))[:5]))]
    got = rank.nearest_each(spark.createDataFrame(asked, "query_id int, path string"), spark.createDataFrame(held, "pos int, path string"))
    assert sorted((x.query_id, x.pos, x.distance, x["rank"]) for x in got.collect()) == sorted(want)


def test_normalizing(spark):
    values = {k: [float(i), 2.0 * i, -1.0 * i] for i, k in enumerate(KEYPOINTS, 1)} | {"tail": [1.0]}
    df = spark.createDataFrame([(values,)], "kp map<string,array<double>>")
    got = df.select(P.coerce(df, "kp").alias("p")).first()["p"]
    assert tuple(got["hips"]) == (0.0, 0.0, 0.0) and tuple(got["neck"]) == (3.0, 6.0, -3.0)
    lacking = spark.createDataFrame([({"hips": [0.0, 0.0, 0.0]},)], "kp map<string,array<double>>")
    with pytest.raises(Exception, match="missing keypoints: left_wrist"):
        lacking.select(P.coerce(lacking, "kp")).collect()
    short = spark.createDataFrame([(values | {"neck": [1.0]},)], "kp map<string,array<double>>")
    with pytest.raises(Exception, match="expected 3 values, got 1"):
        short.select(P.coerce(short, "kp")).collect()
    nan = spark.createDataFrame([(values | {"hips": [NAN] * 3},)], "kp map<string,array<double>>")
    got = nan.select(P.coerce(nan, "kp").alias("p")).first()["p"]
    assert tuple(got["hips"]) == (0.0, 0.0, 0.0) and math.isnan(got["neck"]["x"])
    already = spark.range(1).select(as_pose(REST | FRAME["compat"][0] | {"hips": (5.0, 0.0, 0.0)}).alias("p"))
    assert already.select(P.coerce(already, "p").alias("q")).first()["q"]["hips"]["x"] == 5.0


def test_units(spark):
    df = spark.createDataFrame([("m",), ("cm",), ("original",)], "u string")
    assert [r[0] for r in df.select(P.scaled(F.lit(50.0), F.col("u"))).collect()] == [0.5, 50.0, 50.0]
    with pytest.raises(Exception, match="unknown unit: ft"):
        spark.range(1).select(P.scaled(F.lit(1.0), "ft")).collect()
    assert spark.range(1).select(P.scaled_if_known(F.lit(1.0), F.lit("ft"))).first()[0] == 1.0


P1, P2, P3 = "1" * 72, "1" * 30 + "2" * 42, "3" * 72


def samples(spark, *rows):
    return spark.createDataFrame(rows, "path string, label string")


@pytest.mark.parametrize("labels, want", [(["a", "a", "b", "b"], "b"), (["walk", "run", "run", "run"], "run"), (["A", "a"], "a")])
def test_majority(spark, labels, want):
    tree = train.nodes(train.counts(samples(spark, *((P1, x) for x in labels))))
    assert {r.resolved_label for r in tree.collect()} == {want} and tree.count() == 13


def test_labels_stay_where_there_are_no_samples(spark):
    before = spark.createDataFrame([(0, "", "walk")], "depth int, node_path string, resolved_label string")
    got = train.refinalized(before, spark.createDataFrame([], train.COUNTS)).collect()
    assert [(r.depth, r.resolved_label) for r in got] == [(0, "walk")]


def test_samples_without_label_are_errors(spark):
    with pytest.raises(Exception, match="no label"):
        train.counts(samples(spark, (P1, None))).collect()


def answer(spark, tree, path, config=DEFAULT):
    return predict.predict(spark.createDataFrame([(path,)], "path string"), tree, config).first()


def test_predictions(spark):
    empty = train.nodes(spark.createDataFrame([], train.COUNTS))
    r = answer(spark, empty, P1)
    assert (r.predicted, r.terminated_at_depth, r.fallback_triggered, len(r.steps)) == (None, 0, True, 1)
    counts = train.counts(samples(spark, (P1, "walk")))
    tree = train.nodes(counts)
    r = answer(spark, tree, P1)
    assert (r.predicted, r.terminated_at_depth, r.fallback_triggered, len(r.steps)) == ("walk", 12, False, 13)
    assert r.steps[0].combination_index is None and r.steps[12].combination_index == "111111"
    r = answer(spark, tree, P2)
    assert (r.predicted, r.terminated_at_depth, r.fallback_triggered, len(r.steps)) == ("walk", 5, True, 6)
    blank = tree.withColumn("resolved_label", F.lit(None).cast("string"))
    r = answer(spark, blank, P1)
    assert (r.predicted, r.terminated_at_depth, r.fallback_triggered) == (None, 12, False)
    live = train.stale(tree, train.merge(counts, train.counts(samples(spark, (P3, "run")))))
    r = answer(spark, live, P3)
    assert (r.predicted, r.terminated_at_depth, r.steps[0].total_samples, r.steps[12].resolved_label) == ("walk", 12, 2, None)
    assert answer(spark, live, P3, PoseConfig(fallback="none")).predicted is None


def test_a_gap_ends_the_descent(spark):
    tree = train.nodes(train.counts(samples(spark, (P1, "walk")))).where("depth <> 4")
    assert answer(spark, tree, P1).terminated_at_depth == 3


def test_merging_is_training_on_all(spark):
    rows = [(P1, "a"), (P2, "b"), (P2, "a"), (P3, "c")]
    whole = {tuple(r) for r in train.counts(samples(spark, *rows)).collect()}
    parts = train.merge(train.counts(samples(spark, *rows[:2])), train.counts(samples(spark, *rows[2:])))
    assert {tuple(r) for r in parts.select("depth", "node_path", "label", "n").collect()} == whole
    profile = train.nodes(parts).groupBy("depth").agg(F.sum("total_samples").alias("n")).collect()
    assert {r.n for r in profile} == {4} and len(profile) == 13
    assert {r.node_path for r in train.leaves(train.nodes(parts)).collect()} == {P1, P2, P3}


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("b", "")], "expected string, predicted string")
    assert tuple(evaluate.accuracy(rows).first()) == (4.0, 2.0, 0.5)
    assert tuple(evaluate.accuracy(rows.where("false")).first()) == (0.0, 0.0, 0.0)
    got = {(r.expected, r.predicted): r.n for r in evaluate.confusion(rows).collect()}
    assert got == {("a", "a"): 1, ("a", "__unknown__"): 1, (None, "__unknown__"): 1, ("b", "__unknown__"): 1}
    assert evaluate.confusion_maps(evaluate.confusion(rows)).count() == 3


def test_metadata(spark, tmp_path):
    text = '{"samples":[{"sample_name":"a","combination_indices":["730354"]},{"combination_indices":["730354"]},{"sample_name":null,"combination_indices":[]},{"sample_name":"b"},{"sample_name":"c","combination_indices":"x"},{"sample_name":"d","combination_indices":null},{"sample_name":"e","combination_indices":["000000"]}]}'
    (tmp_path / "m.json").write_text(text)
    found = metadata.load(spark, str(tmp_path / "m.json"))
    assert [(r.sample_name, r.combination_indices) for r in found.orderBy("pos").collect()] == [("a", ["730354"]), ("unknown", ["730354"]), ("None", []), ("b", []), ("e", ["000000"])]
    near = rank.nearest(found, ["730354"], 3).collect()
    assert [(r.sample_name, r.distance) for r in near] == [("a", 0.0), ("unknown", 0.0), ("e", 0.5 * 5)]
    assert metadata.load(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "n.json").write_text('{"samples": 3}')
    assert metadata.load(spark, str(tmp_path / "n.json")).count() == 0


def test_distances_agree(spark):
    q, s = P1[:30], P2
    row = spark.range(1).select(rank.distance(F.lit(q), F.lit(s)).alias("a"), rank.code_distance(F.array(*(F.lit(q[k : k + 6]) for k in range(0, 30, 6))), octree.codes(F.lit(s))).alias("b")).first()
    assert row.a == row.b == sum(6 * 2.0**-d for d in range(6, 13))


def numpy_positions(header, values, mode):
    import numpy as np

    found = bvh.skeleton(header, mode)
    at, turn = {}, {}
    for j in found:
        r = np.eye(3)
        for axis, c in j.turns:
            a, k = math.radians(values[c]), "xyz".index(axis)
            m, (p, q) = np.eye(3), [(1, 2), (2, 0), (0, 1)][k]
            m[p, p] = m[q, q] = math.cos(a)
            m[p, q], m[q, p] = -math.sin(a), math.sin(a)
            r = r @ m
        if j is found[0]:
            at[j.name], turn[j.name] = np.array([values[c] for c in j.moves]), r
        else:
            above = j.parent or found[0].name
            at[j.name], turn[j.name] = at[above] + turn[above] @ np.array(j.offset), turn[above] @ r
    return found, at


@pytest.mark.parametrize("mode", bvh.MODES)
def test_kinematics_of_all_joints(spark, mode):
    path = clips.example(spark)
    header = clips.text().split("MOTION")[0]
    rows = {r.frame_index: r["values"] for r in bvh.frames(bvh.clips(spark, path)).collect()}
    assert sorted(rows) == [0, 1, 2]
    for relative in (True, False):
        got = {(r.frame_index, r.joint): (r.x, r.y, r.z) for r in bvh.joint_positions(spark, path, relative=relative, mode=mode).collect()}
        for f, values in rows.items():
            found, at = numpy_positions(header, values, mode)
            assert len(found) == len([1 for k in got if k[0] == f])
            for j in found:
                want = at[j.name] - (at[found[0].name] if relative else 0)
                assert max(abs(a - b) for a, b in zip(got[f, j.name], want)) < 1e-9, (f, j.name)


def test_the_two_ways_of_reading_a_skeleton_differ():
    header = clips.text().split("MOTION")[0]
    compat, strict = ({j.name: j for j in bvh.skeleton(header, m)} for m in ("compat", "strict"))
    assert strict["LeftArm"].parent == "Spine" and compat["LeftArm"].parent == "Hips"
    assert compat["RightArm"].parent is None and compat["Neck"].offset == (0.0, 2.0, 0.0) and strict["Neck"].offset == (0.0, 3.0, 0.5)
    with pytest.raises(ValueError, match="unknown hierarchy mode"):
        bvh.skeleton(header, "other")


def test_clip_errors_and_requests(spark):
    path = clips.example(spark)
    with pytest.raises(ValueError, match="no joint 'Tail'"):
        bvh.joint_positions(spark, path, ["Tail"])
    with pytest.raises(ValueError, match="unknown unit"):
        bvh.joint_positions(spark, path, unit="ft")
    assert bvh.joint_positions(spark, path, ["Hips"], unit="ft", strict_unit=False).count() == 3
    poses = bvh.keypoints(spark, path)
    assert [r.frame_index for r in bvh.asked_frames(spark, poses, [2, 0, 2]).orderBy("pos").collect()] == [2, 0, 2]
    with pytest.raises(Exception, match="frame 3 out of"):
        bvh.asked_frames(spark, poses, [3]).collect()
    assert bvh.joints(spark, path).count() == 11


def test_models_on_disk(spark, tmp_path):
    tree = train.nodes(train.counts(samples(spark, (P1, 'wa"lk'), (P2, "run"), (P2, "été"))))
    keyed = lambda df: {r.node_path: (r.depth, r.total_samples, dict(r.sample_counts), r.resolved_label) for r in df.collect()}
    model.save(tree, str(tmp_path / "m"), "one")
    assert keyed(model.load(spark, str(tmp_path / "m"), "one")) == keyed(tree)
    with pytest.raises(FileNotFoundError):
        model.load(spark, str(tmp_path / "none")).count()
    model.write_json(tree, str(tmp_path / "j"))
    assert keyed(model.read_json(spark, str(tmp_path / "j"))) == keyed(tree)
    assert model.root_boxes(spark, str(tmp_path / "j"))["neck"] == ((-100.0,) * 3, (100.0,) * 3)
    blank = train.nodes(spark.createDataFrame([], train.COUNTS))
    model.write_json(blank, str(tmp_path / "b"))
    assert keyed(model.read_json(spark, str(tmp_path / "b"))) == {"": (0, 0, {}, None)}


def test_streaming_is_batch(spark, tmp_path):
    rows = [(P1, "a"), (P2, "b"), (P2, "b"), (P3, "c")]
    stream = lambda: spark.readStream.schema("path string, label string").parquet(str(tmp_path / "in"))
    for part in (rows[:2], rows[2:]):
        samples(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = training.run_once(stream(), str(tmp_path / "out"))
    want = train.nodes(train.counts(samples(spark, *rows)))
    pick = lambda df: {(r.node_path, r.total_samples, r.resolved_label) for r in df.collect()}
    assert pick(got) == pick(want)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    from posetrie.plans import core

    # the JVM doesn't compile methods beyond 8,000 bytes
    paths = core.QUERIES["pose_path"](spark, sf)
    stages = paths._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    encode = plan_of(core.QUERIES["pose_path"](spark, sf))
    assert "Exchange" not in encode and "Python" not in encode and "l_shipdate" not in encode.split("Physical Plan")[1]
    assert "Python" not in plan_of(core.QUERIES["predict_label"](spark, sf))


@pytest.mark.parametrize("name", ["pose_validate_missing", "combination_index", "keypoints_in_order", "bbox_values", "bvh_keypoints", "bvh_joints", "ask_frame", "ask_candidates", "stream_train", "json_roundtrip", "predict_ancestor_fallback", "rank_top5_per_query", "tree_resolved_labels", "tree_grown", "predict_few", "predict_uneven_boxes", "pose_quarantine", "predict_path_trace", "predict_miss_embeddings", "eval_confusion", "euler_matrix", "fk_chain", "metadata_filter"])
def test_queries_and_their_sql(spark, name):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("lineitem", "embeddings", "nation", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(__spark_entry__.oracle_sql()[name]).fetchall()
    names = [d[0] for d in db.sql(__spark_entry__.oracle_sql()[name]).description]
    order = [names.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted((tuple(r[k] for k in order) for r in want), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_matrix_and_turns_agree(spark):
    angles = [F.lit(x) for x in (30.0, -50.0, 70.0)]
    m = rotation.applied(rotation.matrix_zyx(*angles), [F.lit(x) for x in (1.0, 2.0, 3.0)])
    v = tuple(F.lit(x) for x in (1.0, 2.0, 3.0))
    t = rotation.turned("z", angles[0], rotation.turned("y", angles[1], rotation.turned("x", angles[2], v)))
    row = spark.range(1).select(*m, *t).first()
    assert all(abs(row[k] - row[k + 3]) < 1e-12 for k in range(3))


def test_asking_a_model(spark, tmp_path):
    from posetrie.query import ask, sample_metadata

    clip = clips.example(spark)
    placed = octree.with_path(model.stored(bvh.keypoints(spark, clip)), "pose").withColumn("sample_name", F.concat(F.lit("f"), F.col("frame_index").cast("string")))
    model.save(train.nodes(train.counts(placed.select("path", F.col("sample_name").alias("label")))), str(tmp_path / "m"))
    named = sample_metadata(placed).select(F.to_json(F.struct("*")).alias("json"), "sample_name").orderBy("sample_name")
    lines = [r.json for r in named.collect()]
    (tmp_path / "s.json").write_text('{"samples":[' + ",".join(lines) + "]}")
    got = ask(spark, clip, 1, str(tmp_path / "m"), str(tmp_path / "s.json"))
    row = got.prediction.first()
    assert (row.predicted, row.terminated_at_depth, row.fallback_triggered) == ("f1", 12, False)
    near = got.candidates.collect()
    assert near[0].sample_name == "f1" and near[0].distance == 0.0 and len(near) == 3
    assert ask(spark, clip, 1, str(tmp_path / "m"), str(tmp_path / "none.json")).candidates.count() == 0


def test_clips_in_a_table_are_asked_frame_by_frame(spark, tmp_path):
    from posetrie.query import ask

    path = clips.example(spark)
    read = bvh.clips(spark, path)
    text = spark.read.text(path, wholetext=True).select(F.lit("one").alias("file"), "value")
    rows = lambda df: sorted((r.pos, r.frame_index, r.t_seconds, r.pose) for r in df.collect())
    every = bvh.keypoints(spark, path)
    assert rows(bvh.keypoints(spark, read, indices=[2, 0, 2])) == rows(bvh.asked_frames(spark, every, [2, 0, 2]))
    for wrong in (3, -1):
        with pytest.raises(Exception, match=f"frame {wrong} out of"):
            bvh.keypoints(spark, read, indices=[wrong]).collect()
    model.save(train.tree(octree.with_path(every, "pose").select("path", F.col("frame_index").cast("string").alias("label"))), str(tmp_path / "m"))
    # a code that isn't one differs in all keypoints, whatever commas it has
    odd = ['["000000","000000"]', '["000000,000000"]', '["000000",null]', '["0000000","00000"]', "[]"]
    (tmp_path / "s.json").write_text('{"samples":[' + ",".join(f'{{"sample_name":"{k}","combination_indices":{c}}}' for k, c in enumerate(odd)) + "]}")
    by_path, by_table = (ask(spark, c, 1, str(tmp_path / "m"), str(tmp_path / "s.json")) for c in (path, bvh.parsed(text)))
    assert by_table.prediction.first().predicted == by_path.prediction.first().predicted == "1"
    near = [{r.sample_name: r.distance for r in a.candidates.collect()} for a in (by_path, by_table)]
    assert near[0] == near[1] and near[0]["1"] == near[0]["4"] == max(near[0].values()) and len(near[0]) == 5


def test_no_method_of_poses_in_structs_is_too_long_for_the_compiler(spark):
    poses = model.stored(bvh.keypoints(spark, clips.example(spark)))
    stages = octree.with_path(poses, "pose")._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
