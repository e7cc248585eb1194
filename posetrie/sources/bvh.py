"""Motion clips in BVH text: joints, frames, and positions by forward kinematics.

hierarchy 'compat' (the default) reads a skeleton as the programs do that trees come from: an end
site isn't a level of its own, so that its closing brace ends the joint before it, and its offset
replaces that joint's; channels are taken to be the root's six and three for every other joint, in
file order, rotations as Z, Y, X. 'strict' reads what the file says: nesting, offsets, channels.
The two differ in the parents of joints that follow an end site.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posetrie.config import DEFAULT, JOINT_OF, PoseConfig
from posetrie.functions import rotation
from posetrie.functions.pose import VECTOR, scaled

MODES = ("compat", "strict")


@dataclass(frozen=True)
class Joint:
    """turns: (axis, channel) in the order in which the rotations multiply; moves: channels of x, y, z (the root's)."""

    name: str
    parent: str | None
    offset: tuple[float, float, float]
    turns: tuple[tuple[str, int], ...]
    moves: tuple[int, ...] = ()


@dataclass
class _Node:
    """A joint of the hierarchy as the file nests it; an end site has no name."""

    name: str | None
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    channels: tuple[str, ...] = ()
    children: tuple[_Node, ...] = ()


def _hierarchy(header: str) -> _Node:
    """The nested joints of a header's text."""
    words = iter(header.partition("ROOT")[2].split())

    def block(name: str | None) -> _Node:
        node = _Node(name)
        for word in words:
            if word == "OFFSET":
                node.offset = tuple(float(next(words)) for _ in "xyz")
            elif word == "CHANNELS":
                node.channels = tuple(next(words) for _ in range(int(next(words))))
            elif word == "JOINT":
                node.children += (block(next(words)),)
            elif word == "End":
                node.children += (block(None),)
            elif word == "}":
                return node
        raise ValueError(f"the hierarchy ends within {name or 'an end site'}")

    try:
        return block(next(words))
    except StopIteration:
        raise ValueError("no joints in the hierarchy") from None


def _in_file_order(node: _Node) -> list[_Node]:
    return [node, *(x for c in node.children if c.name for x in _in_file_order(c))]


def _nested(root: _Node) -> dict[str, tuple[str | None, tuple[float, float, float]]]:
    """Parent and offset of each joint, as the file says."""
    above = {c.name: node.name for node in _in_file_order(root) for c in node.children if c.name}
    return {node.name: (above.get(node.name), node.offset) for node in _in_file_order(root)}


def _flattened(root: _Node) -> dict[str, tuple[str | None, tuple[float, float, float]]]:
    """The same where an end site isn't a level of its own: it gives its offset to its joint and closes one level more."""
    found: dict[str, list] = {}
    line: list[str] = []

    def close() -> None:
        del line[-1:]

    def visit(node: _Node) -> None:
        found[node.name] = [line[-1] if line else found.get(node.name, [None])[0], node.offset]
        line.append(node.name)
        for child in node.children:
            if child.name:
                visit(child)
            else:
                if line:
                    found[line[-1]][1] = child.offset
                close()
        close()

    visit(root)
    return {name: (parent, offset) for name, (parent, offset) in found.items()}


def skeleton(header: str, mode: str = "compat") -> list[Joint]:
    """The joints of a clip's header, in file order, the root first."""
    if mode not in MODES:
        raise ValueError(f"unknown hierarchy mode {mode!r}; known: {', '.join(MODES)}")
    root = _hierarchy(header)
    placed = _nested(root) if mode == "strict" else _flattened(root)
    channels = {node.name: node.channels for node in _in_file_order(root)}
    joints, start = [], 0
    for name, (parent, offset) in placed.items():
        is_root = name == root.name
        if mode == "strict":
            own = channels[name]
        else:
            own = (*(f"{a}position" for a in "XYZ" if is_root), *(f"{a}rotation" for a in "ZYX"))
        at = {c: start + k for k, c in enumerate(own)}
        turns = tuple((c[0].lower(), k) for c, k in at.items() if c.endswith("rotation"))
        moves = tuple(at[f"{a}position"] for a in "XYZ" if f"{a}position" in at) if is_root else ()
        joints.append(Joint(name, None if is_root else parent, offset, turns, moves))
        start += len(own)
    return joints


def clips(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, frame_time, rows) of the clips in path; rows are the lines of the motion part."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def parsed(documents: DataFrame) -> DataFrame:
    """clips() of a table (file, value) of names and texts, which suits many small clips better than as many files."""
    whole = documents.select("file", F.split("value", r"(?m)^\s*MOTION\s*$", 2).alias("parts"))
    motion = F.split(F.trim(F.regexp_replace(F.get("parts", F.lit(1)), r"\r", "")), r"\n")
    seen = whole.select("file", F.get("parts", F.lit(0)).alias("header"), motion.alias("m"))
    time = F.try_element_at(F.split(F.trim(F.filter("m", lambda x: F.startswith(F.trim(x), F.lit("Frame Time")))[0]), r":\s*"), F.lit(2))
    rows = F.filter("m", lambda x: F.regexp_like(x, F.lit(r"^\s*[-+.0-9]")))
    return seen.select("file", "header", time.cast("double").alias("frame_time"), rows.alias("rows"))


def frames(clip: DataFrame) -> DataFrame:
    """(file, frame_index, t_seconds, values) of clips."""
    each = clip.select("file", "frame_time", F.posexplode("rows").alias("frame_index", "row"))
    values = F.transform(F.split(F.trim("row"), r"\s+"), lambda x: x.cast("double"))
    return each.select("file", "frame_index", (F.col("frame_index") * F.col("frame_time")).alias("t_seconds"), values.alias("values"))


def frames_at(clip: DataFrame, indices: Sequence[int]) -> DataFrame:
    """frames() of the asked indices alone, with pos, in the order asked for, repeats included; an index out of range is an error. A clip without frames has none."""
    wanted = F.array(*(F.lit(int(i)) for i in indices)).cast("array<int>")
    each = clip.where(F.size("rows") > 0).select("file", "frame_time", "rows", F.posexplode(wanted).alias("pos", "asked"))
    last = F.size("rows") - 1
    error = F.raise_error(F.concat(F.lit("frame "), F.col("asked").cast("string"), F.lit(" out of [0, "), last.cast("string"), F.lit("]"))).cast("int")
    checked = each.withColumn("frame_index", F.when((F.col("asked") >= 0) & (F.col("asked") <= last), F.col("asked")).otherwise(error))
    values = F.transform(F.split(F.trim(F.get("rows", F.col("frame_index"))), r"\s+"), lambda x: x.cast("double"))
    return checked.select("pos", "file", "frame_index", (F.col("frame_index") * F.col("frame_time")).alias("t_seconds"), values.alias("values"))


def joints(spark: SparkSession, path: str, mode: str = "compat") -> DataFrame:
    """(header, idx, name, parent, ox, oy, oz, ch_start, ch_count) of each different skeleton in path."""
    rows = []
    for header, found in _skeletons(clips(spark, path), mode):
        for k, j in enumerate(found):
            used = sorted([*j.moves, *(c for _, c in j.turns)])
            rows.append((header, k, j.name, j.parent, *map(float, j.offset), used[0] if used else None, len(used)))
    return spark.createDataFrame(rows, "header string, idx int, name string, parent string, ox double, oy double, oz double, ch_start int, ch_count int")


#: Different skeletons in one call; each has a plan of its own.
MOST_SKELETONS = 64


def _skeletons(clip: DataFrame, mode: str) -> list[tuple[str, list[Joint]]]:
    """Each different header with its joints. Headers are short, and many clips share one; too many different ones are an error."""
    headers = [r[0] for r in clip.select("header").distinct().orderBy("header").limit(MOST_SKELETONS + 1).collect()]
    if len(headers) > MOST_SKELETONS:
        raise ValueError(f"more than {MOST_SKELETONS} different skeletons; read the clips of some at a time")
    return [(header, skeleton(header, mode)) for header in headers]


def _chain(by_name: dict[str, Joint], root: str, name: str) -> list[Joint] | None:
    """The joints from below the root down to name; None if a parent doesn't come before its child."""
    chain = []
    order = list(by_name)
    while name != root:
        joint = by_name[name]
        chain.append(joint)
        above = joint.parent or root
        if above not in by_name or order.index(above) > order.index(name):
            return None
        name = above
    return chain[::-1]


def _turned(joint: Joint, v: rotation.Vector, values: Column) -> rotation.Vector:
    for axis, channel in reversed(joint.turns):
        v = rotation.turned(axis, values[channel], v)
    return v


def _root_values(root: Joint, values: Column) -> list[Column]:
    return [values[c] for c in root.moves] if len(root.moves) == 3 else [F.lit(0.0)] * 3


def positions(df: DataFrame, found: Sequence[Joint], names: Sequence[str], relative: bool = True, prefix: str = "__p") -> DataFrame:
    """df (values, more) with a struct of x, y, z for each named joint, relative to the root joint or not.

    Each position is worked out from its joint up to the root, one projection a step, so that no
    expression holds another one's text. Only the joints of the asked chains are looked at.
    """
    by_name = {j.name: j for j in found}
    lost = [n for n in names if n not in by_name]
    if lost:
        raise ValueError(f"no joint {lost[0]!r}; known: {', '.join(list(by_name)[:10])}...")
    root = found[0]
    chains = {n: _chain(by_name, root.name, n) for n in names}
    if skipped := [n for n, c in chains.items() if c is None]:
        raise ValueError(f"the position of joint {skipped[0]!r} can't be computed")
    kept = df.columns
    state = {n: f"{prefix}{k}" for k, n in enumerate(names)}
    df = df.select("*", *(F.lit(0.0).alias(f"{s}_{a}") for s in state.values() for a in "xyz"))
    for step in range(max((len(c) for c in chains.values()), default=0) + 1):
        columns = []
        for name, s in state.items():
            chain, v = chains[name], tuple(F.col(f"{s}_{a}") for a in "xyz")
            at = len(chain) - step
            if at >= 1:
                moved = tuple(x + o for x, o in zip(v, chain[at - 1].offset))
                v = _turned(chain[at - 2] if at >= 2 else root, moved, F.col("values"))
            elif step == len(chain) and not relative:
                pass
            columns += [c.alias(f"{s}_{a}") for c, a in zip(v, "xyz")]
        df = df.select(*kept, *columns)
    shift = [F.lit(0.0)] * 3 if relative else _root_values(root, F.col("values"))
    made = [F.struct(*((F.col(f"{s}_{a}") + shift[k]).alias(a) for k, a in enumerate("xyz"))).alias(n) for n, s in state.items()]
    return df.select(*kept, *made)


def _by_skeleton(spark: SparkSession, path: str | DataFrame, mode: str, work, of=frames) -> DataFrame:
    """work(frames with file, frame_index, t_seconds, values; joints) for the clips of each skeleton, united; path may be clips() that have been read."""
    clip = clips(spark, path) if isinstance(path, str) else path
    parts = [work(of(clip.where(F.col("header") == header)), found) for header, found in _skeletons(clip, mode)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


KEYS = ("file", "frame_index", "t_seconds")


def _with_unit(point: Column, unit: str) -> Column:
    return F.struct(*(scaled(point[a], unit).alias(a) for a in "xyz"))


def joint_positions(spark: SparkSession, path: str, names: Sequence[str] | None = None, relative: bool = True, unit: str = "original", mode: str = "compat", strict_unit: bool = True) -> DataFrame:
    """(file, frame_index, t_seconds, joint, x, y, z) of the named joints, or of all that can be computed.

    An unknown unit is an error; with strict_unit off it is taken as 'original'.
    """
    if unit not in ("original", "cm", "m"):
        if strict_unit:
            raise ValueError(f"unknown unit: {unit}; known: original, cm, m")
        unit = "original"

    def work(rows: DataFrame, found: list[Joint]) -> DataFrame:
        by_name = {j.name: j for j in found}
        asked = list(names) if names is not None else [n for n in by_name if _chain(by_name, found[0].name, n) is not None]
        placed = positions(rows, found, asked, relative)
        each = F.array(*(F.struct(F.lit(n).alias("joint"), _with_unit(F.col(f"`{n}`"), unit).alias("p")) for n in asked))
        return placed.select(*KEYS, F.explode(each).alias("j")).select(*KEYS, "j.joint", "j.p.x", "j.p.y", "j.p.z")

    return _by_skeleton(spark, path, mode, work)


def keypoints(spark: SparkSession, path: str | DataFrame, mode: str = "compat", config: PoseConfig = DEFAULT, indices: Sequence[int] | None = None) -> DataFrame:
    """(file, frame_index, t_seconds, pose): the relative pose of every frame, in the clip's own unit; or, with pos, of frames_at() some indices."""
    keys, of = (KEYS, frames) if indices is None else (("pos", *KEYS), lambda clip: frames_at(clip, indices))

    def work(rows: DataFrame, found: list[Joint]) -> DataFrame:
        placed = positions(rows, found, [JOINT_OF[k] for k in config.keypoints])
        return placed.select(*keys, F.struct(*(F.col(f"`{JOINT_OF[k]}`").cast(VECTOR).alias(k) for k in config.keypoints)).alias("pose"))

    return _by_skeleton(spark, path, mode, work, of)


def asked_frames(spark: SparkSession, poses: DataFrame, indices: Sequence[int]) -> DataFrame:
    """poses of the asked frames with pos, in the order asked for, repeats included; an index out of range is an error."""
    wanted = F.array(*(F.lit(int(i)) for i in indices)).cast("array<int>")
    files = poses.groupBy("file").agg(F.max("frame_index").alias("last"))
    every = files.select("file", "last", F.posexplode(wanted).alias("pos", "asked"))
    sound = (F.col("asked") >= 0) & (F.col("asked") <= F.col("last"))
    error = F.raise_error(F.concat(F.lit("frame "), F.col("asked").cast("string"), F.lit(" out of [0, "), F.col("last").cast("string"), F.lit("]"))).cast("int")
    checked = every.select("pos", "file", F.when(sound, F.col("asked")).otherwise(error).alias("frame_index"))
    return checked.join(poses, ["file", "frame_index"])
