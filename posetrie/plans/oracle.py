"""The queries in DuckDB's SQL. Paths are found by halving, not by the closed form that the Spark side has."""

from __future__ import annotations

from posetrie.config import DEFAULT, JOINT_OF, KEYPOINTS
from posetrie.plans.poses import ABSOLUTE_POSE, ASKED, CHANNELS, CLIP_FRAMES, COARSE_POSE, LINE_KEYS, LINE_POSE, NATION_POSE, embedded, paths_sql

D, W = DEFAULT.max_depth, DEFAULT.width
LINES = paths_sql("paths", "lineitem", LINE_POSE, LINE_KEYS)
VECTORS = paths_sql("vectors", "embeddings", embedded(1), ("vec_id",))


def counted(name: str, where: str = "true", source: str = "paths") -> str:
    return (
        f"{name} AS (SELECT d AS depth, substring(path, 1, CAST(d * {W} AS BIGINT)) AS node_path, l_returnflag AS label, count(*) AS n "
        f"FROM {source}, (SELECT unnest(range({D + 1})) AS d) WHERE {where} GROUP BY ALL)"
    )


def noded(name: str, counts: str) -> str:
    return f"{name} AS (SELECT depth, node_path, CAST(sum(n) AS BIGINT) AS total_samples, arg_max(label, {{'n': n, 'l': label}}) AS resolved_label FROM {counts} GROUP BY ALL)"


TREE = f"WITH {LINES}, {counted('counts')}, {noded('nodes', 'counts')}"
FINISHED = f"WITH {LINES}, {counted('old', chr(108) + '_linestatus = ' + repr('F'))}, {noded('old_nodes', 'old')}"
LIVE = f"{FINISHED}, {counted('counts')}, {noded('new_nodes', 'counts')}, nodes AS (SELECT n.depth, n.node_path, n.total_samples, o.resolved_label FROM new_nodes n LEFT JOIN old_nodes o USING (depth, node_path))"


def steps(queries: str, keys: str, nodes: str) -> str:
    """matched: every query's nodes on its path (trained trees hold every prefix of a node's path); ends: the last of them."""
    return (
        f"matched AS (SELECT {keys}, q.path, n.depth, n.node_path, n.total_samples, n.resolved_label FROM (SELECT *, unnest(range({D + 1})) AS at FROM {queries}) q "
        f"JOIN {nodes} n ON n.depth = q.at AND n.node_path = substring(q.path, 1, CAST(q.at * {W} AS BIGINT))), "
        f"ends AS (SELECT {keys}, path, max(depth) AS depth, arg_max(resolved_label, depth) FILTER (resolved_label IS NOT NULL) AS nearest, "
        f"max_by({{'l': resolved_label}}, depth).l AS own FROM matched GROUP BY ALL)"
    )


# a line's keys may repeat in lineitem; each path is answered once and joined to its lines
ANSWERS = "SELECT DISTINCT path FROM paths"
PREDICT = f"{FINISHED}, asked AS ({ANSWERS}), {steps('asked', 'path AS asked_path', 'old_nodes')}"
PREDICT_STALE = f"{LIVE}, asked AS ({ANSWERS}), {steps('asked', 'path AS asked_path', 'nodes')}"
OF_LINES = "FROM paths JOIN ends e ON e.asked_path = paths.path"
JUDGED = f"{PREDICT}, judged AS (SELECT l_returnflag AS expected, e.nearest AS predicted {OF_LINES})"


def distance(q: str, s: str) -> str:
    parts = []
    for d in range(D):
        differ = " + ".join(f"(substring({q}, {1 + d * W + k}, 1) <> substring({s}, {1 + d * W + k}, 1))::INT" for k in range(W))
        parts.append(f"{2.0 ** -(d + 1)!r}::DOUBLE * ({differ})")
    return " + ".join(parts)


def matrix(z: str, y: str, x: str) -> list[list[str]]:
    c, s = (lambda a: f"cos(radians({a}))"), (lambda a: f"sin(radians({a}))")
    return [
        [f"{c(z)}*{c(y)}", f"({c(z)}*{s(y)}*{s(x)} - {s(z)}*{c(x)})", f"({c(z)}*{s(y)}*{c(x)} + {s(z)}*{s(x)})"],
        [f"{s(z)}*{c(y)}", f"({s(z)}*{s(y)}*{s(x)} + {c(z)}*{c(x)})", f"({s(z)}*{s(y)}*{c(x)} - {c(z)}*{s(x)})"],
        [f"-{s(y)}", f"{c(y)}*{s(x)}", f"{c(y)}*{c(x)}"],
    ]


EULER = matrix("l_quantity*7e0", "l_discount*900e0", "l_tax*1000e0")


def _chain() -> str:
    """The three joints from the root on, by matrices."""
    mats = [matrix("l_quantity", "0e0", "0e0"), matrix("5e0", "l_discount*300e0", "0e0"), matrix("0e0", "-10e0", "l_tax*400e0")]
    offsets = [(1.0, 2.0, 0.5), (0.0, 3.0, -0.25), (2.0, 0.0, 1.0)]
    cols = ", ".join(f"{m[i][j]} AS r{k}{i}{j}" for k, m in enumerate(mats) for i in range(3) for j in range(3))
    last = {2: [f"(r2{i}0*{offsets[2][0]}e0 + r2{i}1*{offsets[2][1]}e0 + r2{i}2*{offsets[2][2]}e0)" for i in range(3)]}
    s1 = ", ".join(f"{last[2][i]} + {offsets[1][i]}e0 AS a{i}" for i in range(3))
    s2 = ", ".join(f"(r1{i}0*a0 + r1{i}1*a1 + r1{i}2*a2) + {offsets[0][i]}e0 AS b{i}" for i in range(3))
    s3 = ", ".join(f"round(r0{i}0*b0 + r0{i}1*b1 + r0{i}2*b2, 6) + 0e0 AS {a}" for i, a in enumerate("xyz"))
    return f"WITH r AS (SELECT l_orderkey, l_linenumber, {cols} FROM lineitem), s1 AS (SELECT *, {s1} FROM r), s2 AS (SELECT *, {s2} FROM s1) SELECT l_orderkey, l_linenumber, {s3} FROM s2"


COARSE = f"WITH {paths_sql('paths', 'lineitem', COARSE_POSE, LINE_KEYS)}, {counted('counts')}, {noded('nodes', 'counts')}"

#: The library's clip as it is read by default: each joint's parent, offset and first rotation channel, by hand.
CLIP_JOINTS = """('Hips', NULL, 0, 0, 0, 3), ('Spine', 'Hips', 0, 4, 0, 6), ('Neck', 'Spine', 0, 2, 0, 9), ('LeftArm', 'Hips', 2, 1, 0, 12), ('LeftHand', 'LeftArm', 1, 0, 0, 15),
 ('RightArm', 'Hips', -2, 1, 0, 18), ('RightHand', 'RightArm', -1, 0, 0, 21), ('LeftLeg', 'Hips', 1, -1, 0, 24), ('LeftFoot', 'LeftLeg', 0, -1, 1, 27), ('RightLeg', 'Hips', -1, -1, 0, 30), ('RightFoot', 'RightLeg', 0, -1, 1, 33)"""


def _clips(joints: dict[str, str]) -> str:
    """CTEs up to walk: the joints (by the names they go by) of every customer's frame, from each up to the root, by matrices."""
    keys = ", ".join(f"('{k}', '{joint}')" for k, joint in joints.items())
    m = matrix("f.v[p.ch + 1]", "f.v[p.ch + 2]", "f.v[p.ch + 3]")
    turned = ", ".join(f"{m[i][0]}*(w.x + j.ox) + {m[i][1]}*(w.y + j.oy) + {m[i][2]}*(w.z + j.oz)" for i in range(3))
    frames = f"SELECT c_custkey // {CLIP_FRAMES} AS clip, row_number() OVER (PARTITION BY c_custkey // {CLIP_FRAMES} ORDER BY c_custkey) - 1 AS frame_index, c_custkey, c_mktsegment AS l_returnflag, [{', '.join(CHANNELS)}] AS v FROM customer"
    return (
        f"RECURSIVE joints AS (SELECT * FROM (VALUES {CLIP_JOINTS}) t(name, parent, ox, oy, oz, ch)), frames AS MATERIALIZED ({frames}), "
        f"walk AS (SELECT f.c_custkey, k.keypoint, k.joint, 0e0 AS x, 0e0 AS y, 0e0 AS z FROM frames f, (VALUES {keys}) k(keypoint, joint) UNION ALL "
        f"SELECT w.c_custkey, w.keypoint, p.name, {turned} FROM walk w JOIN joints j ON j.name = w.joint JOIN joints p ON p.name = j.parent JOIN frames f ON f.c_custkey = w.c_custkey)"
    )


def _joints() -> str:
    at = ", ".join(f"round((x{i} + f.v[{i + 1}]) / 100e0, 6) + 0e0 AS {a}" for i, a in enumerate("xyz"))
    return f"WITH {_clips({'Spine': 'Spine', 'LeftArm': 'LeftArm'})} SELECT clip, frame_index::INT AS frame_index, keypoint AS joint, {at} FROM (SELECT c_custkey, keypoint, x AS x0, y AS x1, z AS x2 FROM walk WHERE joint = 'Hips') JOIN frames f USING (c_custkey)"


def _asked() -> str:
    """CTEs up to ends: frame ASKED of every clip, looked up in the tree of all other frames."""
    wide = ", ".join(f"max({a}) FILTER (keypoint = '{k}') AS {k}_{a}" for k in KEYPOINTS for a in "xyz")
    posed = f"posed AS (SELECT f.clip, f.frame_index, f.c_custkey, f.l_returnflag, {wide} FROM walk JOIN frames f USING (c_custkey) WHERE joint = 'Hips' GROUP BY ALL)"
    at = {k: tuple(f"{k}_{a}" for a in "xyz") for k in KEYPOINTS}
    return (
        f"WITH {_clips(JOINT_OF)}, {posed}, {paths_sql('placed', 'posed', at, ('clip', 'frame_index', 'c_custkey', 'l_returnflag'))}, "
        f"{counted('counts', f'frame_index <> {ASKED}', 'placed')}, {noded('nodes', 'counts')}, asked AS (SELECT clip, path FROM placed WHERE frame_index = {ASKED}), {steps('asked', 'clip', 'nodes')}"
    )


def _candidates() -> str:
    return (
        f"{_asked()}, cut_off AS (SELECT clip, rpad(substring(path, 1, CAST(depth * {W} AS BIGINT)), {D * W}, '8') AS path FROM ends), samples AS (SELECT c_custkey, path FROM placed WHERE frame_index <> {ASKED}), "
        f"scored AS (SELECT clip, s.c_custkey, {distance('a.path', 's.path')} AS distance FROM cut_off a, samples s) "
        "SELECT clip, 'c' || c_custkey AS sample_name, distance, (row_number() OVER (PARTITION BY clip ORDER BY distance, c_custkey))::INT AS rank FROM scored QUALIFY rank <= 5"
    )


#: Metadata of samples as JSON text, of every shape that matters; Spark's and DuckDB's alike.
METADATA_JSON = """CASE l_linenumber
 WHEN 1 THEN concat('{"sample_name":"s', CAST(l_orderkey AS VARCHAR(20)), '","combination_indices":["730354","000111"]}')
 WHEN 2 THEN '{"combination_indices":["730354"]}'
 WHEN 3 THEN '{"sample_name":null,"combination_indices":[]}'
 WHEN 4 THEN '{"sample_name":"b"}'
 WHEN 5 THEN '{"sample_name":"c","combination_indices":"x"}'
 WHEN 6 THEN '{"sample_name":"d","combination_indices":null}'
 ELSE '{"sample_name":7,"combination_indices":["1"]}' END"""

_HIPS = [f"({m})" for m in ABSOLUTE_POSE["hips"]]
SQL = {
    "pose_normalize": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"0e0 AS hips_{a}" if k == "hips" else f"({ABSOLUTE_POSE[k][i]})-{_HIPS[i]} AS {k}_{a}" for k in KEYPOINTS for i, a in enumerate("xyz"))
    + " FROM lineitem",
    "pose_validate_missing": "SELECT l_orderkey, l_linenumber, array_to_string(([" + ", ".join(f"'{k}'" for k in KEYPOINTS) + "])[l_linenumber+1:], ',') AS missing, l_linenumber >= 6 AS complete FROM lineitem",
    "keypoints_unpivot": " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, {i}::INT AS pos, '{k}' AS name, " + ", ".join(f"CAST({LINE_POSE[k][j]} AS DOUBLE) AS {a}" for j, a in enumerate("xyz")) + " FROM lineitem"
        for i, k in enumerate(KEYPOINTS)
    ),
    "keypoints_in_order": " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, {i}::INT AS pos, '{k}' AS name, {'NULL::DOUBLE' if k == 'neck' else f'l_quantity * {len(k)}'} AS value FROM lineitem" for i, k in enumerate(KEYPOINTS)
    ),
    "unit_convert": "SELECT l_orderkey, l_linenumber, (['original','cm','m'])[l_linenumber % 3 + 1] AS unit, CASE WHEN l_linenumber % 3 = 2 THEN l_extendedprice / 100e0 ELSE l_extendedprice END AS length FROM lineitem",
    "octant_level1": f"WITH {VECTORS} SELECT vec_id, " + ", ".join(f"substring(path, {i + 1}, 1)::INT AS {k}" for i, k in enumerate(KEYPOINTS)) + " FROM vectors",
    "octant_levels_all": f"WITH {VECTORS} SELECT vec_id, d::INT AS level, substring(path, CAST({W}*(d-1)+1 AS BIGINT), {W}) AS code FROM vectors, (SELECT unnest(range(1, {D + 1})) AS d)",
    "combination_index": "WITH c AS (SELECT l_orderkey, l_linenumber, [" + ", ".join(f"((l_linenumber+{k}) % 8)::VARCHAR" for k in range(6)) + "] AS o FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, array_to_string(o, '') AS code, array_to_string(o, ',') AS key, array_to_string(o, '') AS read_back FROM c",
    "pose_path": f"WITH {LINES} SELECT l_orderkey, l_linenumber, path FROM paths",
    "bbox_subdivide": "WITH b AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 8)::INT AS octant, -l_quantity AS lo, l_quantity*3e0 AS hi, l_quantity AS mid FROM lineitem) SELECT l_orderkey, l_linenumber, octant, "
    + ", ".join(f"CASE WHEN octant & {1 << i} > 0 THEN mid ELSE lo END AS min_{a}, CASE WHEN octant & {1 << i} > 0 THEN hi ELSE mid END AS max_{a}" for i, a in enumerate("xyz"))
    + ", CASE WHEN octant & 1 > 0 THEN (mid+hi)/2e0 ELSE (lo+mid)/2e0 END AS center_x, CASE WHEN octant & 1 > 0 THEN hi-mid ELSE mid-lo END AS size_x FROM b",
    "bbox_from_path": f"WITH {LINES}, n AS (SELECT DISTINCT substring(path, 1, 24) AS node_path FROM paths), o AS (SELECT node_path, "
    + ", ".join(f"substring(node_path, {2 + W * d}, 1)::INT AS o{d}" for d in range(4))
    + " FROM n) SELECT node_path, "
    + ", ".join(
        f"-100e0 + {' + '.join(f'((o{d} >> {i}) & 1)*{200 / 2 ** (d + 1)!r}' for d in range(4))}{end} AS {name}_{a}" for name, end in (("min", ""), ("max", " + 12.5e0")) for i, a in enumerate("xyz")
    )
    + " FROM o",
    "bbox_values": f"WITH {LINES}, n AS (SELECT DISTINCT substring(path, 1, 12) AS node_path FROM paths), o AS (SELECT node_path, substring(node_path, 3, 1)::INT AS o0, substring(node_path, 9, 1)::INT AS o1 FROM n), "
    + "b AS (SELECT node_path, " + ", ".join(f"-100e0 + ((o0 >> {i}) & 1)*100e0 + ((o1 >> {i}) & 1)*50e0 AS min_{i}" for i in range(3))
    + " FROM o) SELECT *, " + ", ".join(f"min_{i} + 50e0 AS max_{i}" for i in range(3)) + ", min_2 + 25e0 AS center_z, 50e0 AS size_y FROM b",
    "tree_node_counts": f"{TREE} SELECT depth::INT AS depth, node_path, total_samples FROM nodes",
    "tree_label_histogram": f"{TREE} SELECT depth::INT AS depth, node_path, label, n FROM counts",
    "tree_resolved_labels": f"{TREE} SELECT depth::INT AS depth, node_path, resolved_label FROM nodes",
    "tree_children": f"{TREE} SELECT substring(node_path, 1, length(node_path)-{W}) AS parent_path, count(*) AS n_children, CAST(sum(total_samples) AS BIGINT) AS samples_below FROM nodes WHERE depth > 0 GROUP BY ALL",
    "tree_leaves": f"{TREE} SELECT depth::INT AS depth, node_path, total_samples FROM nodes WHERE depth = {D}",
    "tree_depth_profile": f"{TREE} SELECT depth::INT AS depth, count(*) AS n_nodes, CAST(sum(total_samples) AS BIGINT) AS n_samples FROM nodes GROUP BY ALL",
    "tree_rollup_check": f"WITH {paths_sql('paths', 'lineitem', COARSE_POSE, LINE_KEYS)}, c AS (SELECT l_returnflag AS label, "
    + ", ".join(f"substring(path, {1 + W * d}, {W}) AS c{d}" for d in range(D))
    + " FROM paths) SELECT ("
    + " + ".join(f"(1 - grouping(c{d}))" for d in range(D))
    + ")::INT AS depth, concat("
    + ", ".join(f"c{d}" for d in range(D))
    + ") AS node_path, label, count(*) AS n FROM c GROUP BY label, ROLLUP ("
    + ", ".join(f"c{d}" for d in range(D))
    + ")",
    "tree_merge_counts": f"{TREE} SELECT depth::INT AS depth, node_path, label, n FROM counts",
    "tree_stale_labels": f"{LIVE} SELECT depth::INT AS depth, node_path, total_samples, resolved_label FROM nodes",
    "predict_label": f"{PREDICT} SELECT l_orderkey, l_linenumber, e.nearest AS predicted {OF_LINES}",
    "predict_path_trace": f"{PREDICT} SELECT l_orderkey, l_linenumber, m.depth::INT AS depth, CASE WHEN m.depth > 0 THEN right(m.node_path, {W}) END AS combination_index, m.resolved_label, m.total_samples FROM paths JOIN matched m ON m.asked_path = paths.path",
    "predict_termination": f"{PREDICT} SELECT l_orderkey, l_linenumber, e.depth::INT AS terminated_at_depth, e.depth < {D} AS fallback_triggered {OF_LINES}",
    "predict_miss_embeddings": f"{TREE}, {VECTORS}, {steps('vectors', 'vec_id', 'nodes')} SELECT vec_id, nearest AS predicted, depth::INT AS terminated_at_depth, depth < {D} AS fallback_triggered FROM ends",
    "predict_ancestor_fallback": f"{PREDICT_STALE} SELECT l_orderkey, l_linenumber, e.nearest AS predicted, e.depth::INT AS terminated_at_depth {OF_LINES}",
    "predict_no_fallback_strategy": f"{PREDICT_STALE} SELECT l_orderkey, l_linenumber, e.own AS predicted, e.depth::INT AS terminated_at_depth {OF_LINES}",
    "eval_accuracy": f"{JUDGED} SELECT count(*)::DOUBLE AS total, count_if(expected IS NOT DISTINCT FROM predicted)::DOUBLE AS correct, count_if(expected IS NOT DISTINCT FROM predicted)::DOUBLE / count(*) AS accuracy FROM judged",
    "eval_confusion": f"{JUDGED} SELECT expected, coalesce(nullif(predicted, ''), '__unknown__') AS predicted, count(*) AS n FROM judged GROUP BY ALL",
    "eval_empty_accuracy": "SELECT 0e0 AS total, 0e0 AS correct, 0e0 AS accuracy",
    "rank_distance": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {distance(repr('0' * (D * W)), 'path')} AS distance FROM paths",
    "rank_top5_per_query": f"WITH {LINES}, {paths_sql('asked', 'nation', NATION_POSE, ('n_nationkey',))}, s AS (SELECT path, l_orderkey*8+l_linenumber AS pos FROM paths), "
    f"scored AS (SELECT n_nationkey AS query_id, pos, {distance('asked.path', 's.path')} AS distance FROM asked, s) "
    "SELECT query_id, pos, distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, pos))::INT AS rank FROM scored QUALIFY rank <= 5",
    "pose_quarantine": "WITH r AS (SELECT *, CASE l_linenumber WHEN 2 THEN 'no left_wrist' WHEN 3 THEN 'no left_wrist; neck: expected 3 values, got 2' WHEN 5 THEN 'no keypoints' END AS reasons FROM lineitem) "
    f"SELECT l_orderkey, l_linenumber, reasons, CASE WHEN reasons IS NULL THEN ({ABSOLUTE_POSE['neck'][0]})-{_HIPS[0]} END AS neck_x, "
    f"CASE WHEN reasons IS NULL THEN ({ABSOLUTE_POSE['left_wrist'][1]})-{_HIPS[1]} END AS left_wrist_y FROM r",
    "predict_uneven_boxes": f"{FINISHED}, {paths_sql('beside', 'lineitem', LINE_POSE, LINE_KEYS, 0.75)}, asked AS (SELECT DISTINCT path FROM beside), {steps('asked', 'path AS asked_path', 'old_nodes')} "
    f"SELECT l_orderkey, l_linenumber, e.nearest AS predicted, e.depth::INT AS terminated_at_depth, e.depth < {D} AS fallback_triggered FROM beside JOIN ends e ON e.asked_path = beside.path",
    "tree_grown": f"{TREE} SELECT depth::INT AS depth, node_path, total_samples, resolved_label FROM nodes",
    "predict_few": f"{TREE}, {paths_sql('asked', 'nation', NATION_POSE, ('n_nationkey',))}, {steps('asked', 'n_nationkey', 'nodes')} SELECT n_nationkey, nearest AS predicted, depth::INT AS terminated_at_depth FROM ends",
    "euler_matrix": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({EULER[i][j]}, 6) + 0e0 AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM lineitem",
    "fk_chain": _chain(),
    "bvh_keypoints": f"WITH {_clips(JOINT_OF)} SELECT clip, frame_index::INT AS frame_index, keypoint, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM walk JOIN frames USING (c_custkey) WHERE joint = 'Hips'",
    "bvh_joints": _joints(),
    "ask_frame": f"{_asked()} SELECT clip, nearest AS predicted, depth::INT AS terminated_at_depth, depth < {D} AS fallback_triggered FROM ends",
    "ask_candidates": _candidates(),
    "json_roundtrip": f"{COARSE} SELECT n.depth::INT AS depth, node_path, total_samples, resolved_label, c.label, c.n FROM nodes n JOIN counts c USING (depth, node_path)",
    "stream_train": f"{COARSE} SELECT depth::INT AS depth, node_path, total_samples, resolved_label FROM nodes",
    "metadata_filter": f"WITH j AS (SELECT l_orderkey*8+l_linenumber AS pos, ({METADATA_JSON})::JSON AS s FROM lineitem), k AS (SELECT pos, s, s->'combination_indices' AS c FROM j) "
    "SELECT pos, CASE WHEN json_type(s->'sample_name') IS NULL THEN 'unknown' WHEN json_type(s->'sample_name') = 'NULL' THEN 'None' ELSE s->>'sample_name' END AS sample_name, "
    "coalesce(json_array_length(c), 0)::INT AS n_codes, coalesce(array_to_string(CAST(c AS VARCHAR[]), ','), '') AS codes FROM k WHERE c IS NULL OR json_type(c) = 'ARRAY'",
}
