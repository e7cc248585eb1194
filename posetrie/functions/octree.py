"""Octants, cells and paths of a multi-point octree as column expressions.

A path has one code a level, a code one octal digit a keypoint: x counts 1, y 2, z 4 where the
coordinate is in the upper half of the current box. Boundaries belong to the upper half, points
outside the root follow its nearest face, and NaN is in the lower half at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from posetrie.config import AXES, DEFAULT, Box, PoseConfig
from posetrie.functions.pose import vector


def upper(x: Column, center: Column) -> Column:
    """1 where x is in the upper half, else 0. Spark takes NaN for the greatest number; here it is in the lower half."""
    return F.when(F.isnan(x), 0).when(x >= center, 1).otherwise(0)


def octant(point: Column, box: Column) -> Column:
    """The octant (0 to 7) of a point in a box (struct of the vectors min and max)."""
    bits = [upper(point[a], (box["min"][a] + box["max"][a]) / 2.0) for a in AXES]
    return bits[0] + 2 * bits[1] + 4 * bits[2]


def box(low, high) -> Column:
    return F.struct(vector(*low).alias("min"), vector(*high).alias("max"))


def center(b: Column) -> Column:
    return F.struct(*(((b["min"][a] + b["max"][a]) / 2.0).alias(a) for a in AXES))


def size(b: Column) -> Column:
    return F.struct(*((b["max"][a] - b["min"][a]).alias(a) for a in AXES))


def subdivide(b: Column, which: Column) -> Column:
    """The part of a box that an octant names; an octant out of 0 to 7 is an error."""
    bit = {a: which.cast("int").bitwiseAND(1 << k) > 0 for k, a in enumerate(AXES)}
    middle = {a: (b["min"][a] + b["max"][a]) / 2.0 for a in AXES}
    part = F.struct(
        F.struct(*(F.when(bit[a], middle[a]).otherwise(b["min"][a]).alias(a) for a in AXES)).alias("min"),
        F.struct(*(F.when(bit[a], b["max"][a]).otherwise(middle[a]).alias(a) for a in AXES)).alias("max"),
    )
    sound = which.isNotNull() & which.between(0, 7)
    error = F.raise_error(F.concat(F.lit("octant out of 0 to 7: "), F.coalesce(which.cast("string"), F.lit("null"))))
    return F.when(sound, part).otherwise(error.cast("struct<min:struct<x:double,y:double,z:double>,max:struct<x:double,y:double,z:double>>"))


def box_values(b: Column) -> Column:
    """array<array<double>>: the least and the greatest corner."""
    return F.array(*(F.array(*(b[end][a] for a in AXES)) for end in ("min", "max")))


def box_of_values(values: Column) -> Column:
    return box([values[0][k] for k in range(3)], [values[1][k] for k in range(3)])


def cell(x: Column) -> Column:
    """The cell (0 to 4095) of a coordinate in the cube of 200 at depth 12, exact at every edge.

    NaN, null and what lies outside go to the outermost cells.
    """
    given = F.coalesce(x, F.lit(float("nan")))
    return within(near(given, guess(given)))


def guess(x: Column) -> Column:
    """The cell's number from 1 on, or one more just below an edge: the steps of width_bucket are monotone, and exact at edges."""
    return F.coalesce(F.width_bucket(x, F.lit(-100.0), F.lit(100.0), F.lit(4096)), F.lit(0).cast("long"))


def near(x: Column, guess: Column) -> Column:
    """The cell before it is moved inside, -2 to 4096; edges are (25 k - 51200) / 512."""
    return guess - F.when(x * 512.0 < guess.cast("double") * 25.0 - 51225.0, 2).otherwise(1)


def within(cell: Column) -> Column:
    """-2, -1 as 0 and 4096 as 4095: the sign bits clear what is negative, bit 12 is taken from what has it."""
    low = cell.bitwiseAND(F.bitwise_not(F.shiftright(cell, 63)))
    return low - F.shiftright(low, 12)


def cell_by_halving(x: Column, low: float, high: float, depth: int) -> Column:
    """The cell of a coordinate in any root interval, by halving it depth times."""
    start = F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(0).cast("long").alias("k"))

    def step(s: Column, _) -> Column:
        middle = (s["low"] + s["high"]) / 2.0
        bit = upper(x, middle)
        return F.struct(
            F.when(bit == 1, middle).otherwise(s["low"]).alias("low"),
            F.when(bit == 1, s["high"]).otherwise(middle).alias("high"),
            (s["k"] * 2 + bit).cast("long").alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)["k"]


#: Levels up to which a keypoint's digits fit in one number, four bits a digit, and digits of a number beside its mark.
SPREAD, HELD = 12, 15


def _spread(columns: list[Column], step: int) -> list[Column]:
    """A step of moving 12 bits to every fourth bit: copies of groups of bits, of which masks keep one each."""
    if step == 0:
        return [F.shiftleft(c, 18).bitwiseOR(c).bitwiseAND(F.lit(0x3F00003F)) for c in columns]
    if step == 1:
        return [F.shiftleft(c, 9).bitwiseOR(c).bitwiseAND(F.lit(0x7007007007)) for c in columns]
    return [F.shiftleft(c, 6).bitwiseOR(F.shiftleft(c, 3)).bitwiseOR(c).bitwiseAND(F.lit(0x111111111111)) for c in columns]


def groups(config: PoseConfig = DEFAULT) -> list[range]:
    """The levels (from 1) whose codes share a number of pack(): as many as fit."""
    each = HELD // config.width
    return [range(first, min(first + each, config.max_depth + 1)) for first in range(1, config.max_depth + 1, each)]


#: A pose: the name of a column of structs, or three columns of each keypoint.
Pose = str | dict[str, tuple[Column, Column, Column]]


def coordinates(pose: Pose, config: PoseConfig = DEFAULT) -> list[Column]:
    """x, y, z of every keypoint in order."""
    if isinstance(pose, str):
        return [F.col(pose)[name][a] for name in config.keypoints for a in AXES]
    return [c for name in config.keypoints for c in pose[name]]


def with_packed(df: DataFrame, pose: Pose, to: str = "packed", config: PoseConfig = DEFAULT) -> DataFrame:
    """df with the path of a relative pose as numbers to_0, to_1, ..., one for each of groups(), four bits a digit.

    Small projections follow each other: cells, steps of spreading their bits, digits of each
    keypoint, codes level by level; none holds another one's text, and none can be null, so that no
    filter on a path copies them into each other. A null coordinate counts as NaN.
    """
    if config.max_depth > SPREAD or config.width > HELD:
        raise ValueError(f"paths are packed up to depth {SPREAD} and {HELD} keypoints")
    kept = [F.col(f"`{c}`") for c in df.columns]
    at = [(name, a) for name in config.keypoints for a in AXES]
    names = [f"__{name}_{a}" for name, a in at]
    cols = [F.col(f"`{n}`") for n in names]
    guesses = [F.col(f"`{n}_guess`") for n in names]

    def step(df: DataFrame, made: list[Column], *more: Column) -> DataFrame:
        return df.select(*kept, *(c.alias(n) for c, n in zip(made, names)), *more)

    def apart(df: DataFrame, named: list[str] = names) -> DataFrame:
        # a projection with a higher-order function is compiled by itself, and those before and after it
        # each together, so that no method is too long for the JVM's compiler; given as columns, constant
        # coordinates fold away, which does as well
        if not isinstance(pose, str):
            return df
        df = df.select(*kept, F.transform(F.array(*(F.col(f"`{n}`") for n in named)), lambda c: c).alias("__apart"))
        return df.select(*kept, *(F.coalesce(F.get("__apart", F.lit(k)), F.lit(0).cast("long")).alias(n) for k, n in enumerate(named)))

    given = [F.coalesce(c, F.lit(float("nan"))) for c in coordinates(pose, config)]
    if isinstance(pose, str):
        df = df.select(*kept, F.array(*given).alias("__given"))
        given = [F.coalesce(F.get("__given", F.lit(k)), F.lit(float("nan"))) for k in range(len(given))]
    cubes = [config.is_cube(name) for name, _ in at]
    df = step(df, given)
    df = step(df, cols, *(guess(c).alias(f"{n}_guess") for c, n, cube in zip(cols, names, cubes) if cube))
    cells = []
    for (name, a), c, g, cube in zip(at, cols, guesses, cubes):
        low, high = (corner[AXES.index(a)] for corner in config.box(name))
        cells.append(near(c, g) if cube else F.coalesce(cell_by_halving(c, low, high, config.max_depth), F.lit(0).cast("long")))
    df = apart(step(df, cells))
    df = step(df, [within(c) if cube else c for c, cube in zip(cols, cubes)])
    df = apart(step(df, _spread(cols, 0)))
    df = step(df, _spread(cols, 1))
    last = _spread(cols, 2)
    digits = [last[k].bitwiseOR(F.shiftleft(last[k + 1], 1)).bitwiseOR(F.shiftleft(last[k + 2], 2)).alias(names[k]) for k in range(0, len(at), 3)]
    df = apart(df.select(*kept, *digits), names[::3])
    out = []
    for g, levels in enumerate(groups(config)):
        number = None
        end = len(levels) * config.width - 1
        for i, level in enumerate(levels):
            for k in range(config.width):
                digit = F.shiftright(cols[3 * k], 4 * (config.max_depth - level)).bitwiseAND(F.lit(15).cast("long"))
                placed = F.shiftleft(digit, 4 * (end - i * config.width - k))
                number = placed if number is None else number.bitwiseOR(placed)
        out.append(number.alias(f"{to}_{g}"))
    return df.select(*kept, *out)


def packed_text(number: Column, digits: int) -> Column:
    """The digits of one number of a packed path; a mark before them keeps their zeros."""
    return F.substring(F.hex(number.bitwiseOR(F.lit(1 << 4 * digits))), 2, digits)


def packed_of(path: Column, config: PoseConfig = DEFAULT) -> list[Column]:
    """The numbers of a path in text; digits that aren't there are 8, which no path has."""
    whole = F.rpad(path, config.width * config.max_depth, "8")
    return [F.conv(F.substring(whole, 1 + config.width * (g[0] - 1), config.width * len(g)), 16, 10).cast("long") for g in groups(config)]


def with_path(df: DataFrame, pose: Pose, to: str = "path", config: PoseConfig = DEFAULT) -> DataFrame:
    """df with the whole path of a relative pose: max_depth codes in one string."""
    if config.max_depth > SPREAD or config.width > HELD:
        return _with_long_path(df, pose, to, config)
    packed = with_packed(df, pose, "__packed", config)
    texts = [packed_text(F.col(f"__packed_{g}"), len(levels) * config.width) for g, levels in enumerate(groups(config))]
    return packed.select(*(F.col(f"`{c}`") for c in df.columns), F.concat(*texts).alias(to))


def _with_long_path(df: DataFrame, pose: Pose, to: str, config: PoseConfig) -> DataFrame:
    """with_path() for trees of any depth and any number of keypoints, digit by digit."""
    cells, given = {}, iter(coordinates(pose, config))
    for name in config.keypoints:
        low, high = config.box(name)
        for k, a in enumerate(AXES):
            cells[f"__{name}_{a}"] = cell_by_halving(next(given), low[k], high[k], config.max_depth)
    celled = df.select("*", *(c.alias(n) for n, c in cells.items()))

    def digit(name: str, level: int) -> Column:
        bits = [F.shiftright(F.col(f"__{name}_{a}"), config.max_depth - level).bitwiseAND(F.lit(1).cast("long")) for a in AXES]
        return (bits[0] + 2 * bits[1] + 4 * bits[2]).cast("string")

    digits = [digit(name, level) for level in range(1, config.max_depth + 1) for name in config.keypoints]
    return celled.select(*(F.col(f"`{c}`") for c in df.columns), F.concat(*digits).alias(to))


def codes(path: Column, config: PoseConfig = DEFAULT) -> Column:
    """The codes of a path, level by level, as array<string>."""
    return F.array(*(F.substring(path, 1 + config.width * d, config.width) for d in range(config.max_depth)))


def _of_width(text: Column, config: PoseConfig) -> Column:
    """A code as it is; one that hasn't a digit of 0 to 7 for each keypoint is an error."""
    error = F.raise_error(F.concat(F.lit(f"expected {config.width} octants, got: "), text)).cast("string")
    return F.when(text.isNull() | F.regexp_like(text, F.lit(f"^[0-7]{{{config.width}}}$")), text).otherwise(error)


def code(octants: Column, config: PoseConfig = DEFAULT) -> Column:
    """Octants joined into one code; another number of octants than keypoints, or one out of 0 to 7, is an error."""
    return _of_width(F.array_join(octants.cast("array<string>"), ""), config)


def octants(text: Column) -> Column:
    """The octants of a code, as array<tinyint>."""
    return F.transform(F.split(text, ""), lambda d: d.cast("tinyint"))


def child_key(text: Column) -> Column:
    """A code as the model files write it: digits joined by commas."""
    return F.array_join(F.split(text, ""), ",")


def code_of_key(key: Column, config: PoseConfig = DEFAULT) -> Column:
    """The code of a key with commas, blanks and empty parts; checked as code() is."""
    return _of_width(F.array_join(F.filter(F.transform(F.split(key, ","), lambda p: F.trim(p)), lambda p: p != ""), ""), config)


def box_of_path(path: Column, at: int, root: Box = ((-100.0,) * 3, (100.0,) * 3), config: PoseConfig = DEFAULT) -> Column:
    """The box of the at-th keypoint at the node that a path (or prefix) names.

    In the cube of 200 the bits of an axis, read as a number, are the cell, and corners follow exactly;
    other roots are halved digit after digit, as their paths were made.
    """
    digits = F.regexp_replace(path, f".{{{at}}}(.).{{{config.width - at - 1}}}", "$1")
    if root == ((-100.0,) * 3, (100.0,) * 3):
        edge = F.lit(200.0) / F.pow(F.lit(2.0), F.length(digits))
        cells = [F.coalesce(F.conv(F.translate(digits, "01234567", "".join(str(d >> k & 1) for d in range(8))), 2, 10).cast("double"), F.lit(0.0)) for k in range(3)]
        return box([c * edge - 100.0 for c in cells], [(c + 1) * edge - 100.0 for c in cells])
    each = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("int"))
    return F.aggregate(each, box(*root), lambda b, o: subdivide(b, o))


