"""Poses as structs of keypoints: building, checking, normalising, listing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from posetrie.config import AXES, DEFAULT, PoseConfig

VECTOR = T.StructType([T.StructField(a, T.DoubleType()) for a in AXES])


def pose_type(config: PoseConfig = DEFAULT) -> T.StructType:
    return T.StructType([T.StructField(k, VECTOR) for k in config.keypoints])


def vector(x, y, z) -> Column:
    """A vector of three numbers or columns, as doubles."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("double").alias(a) for v, a in zip((x, y, z), AXES)))


def checked_vector(values: Column, what: str = "keypoint") -> Column:
    """A vector of array<double>; any other number of values than three is an error."""
    bad = values.isNull() | (F.size(values) != 3)
    return F.when(bad, F.raise_error(_arity(values, what)).cast(VECTOR)).otherwise(vector(*(F.get(values, F.lit(k)) for k in range(3))))


def missing(keypoints: Column, config: PoseConfig = DEFAULT) -> Column:
    """The names that a map of keypoints lacks, in order."""
    return F.filter(F.array(*map(F.lit, config.keypoints)), lambda name: ~F.map_contains_key(keypoints, name))


def _has_all(keypoints: Column, config: PoseConfig) -> Column:
    found = F.lit(True)
    for name in config.keypoints:
        found = found & F.map_contains_key(keypoints, name)
    return found


def faults(keypoints: Column, config: PoseConfig = DEFAULT) -> Column:
    """What keeps map<string, array<double>> from being a pose, as array<string>: empty for a good one."""
    said = [F.when(~F.map_contains_key(keypoints, name), f"no {name}").otherwise(_fault(keypoints[name], name)) for name in config.keypoints]
    return F.when(keypoints.isNull(), F.array(F.lit("no keypoints"))).otherwise(F.array_compact(F.array(*said)))


def _fault(values: Column, what: str) -> Column:
    """None for three values, else how many there are."""
    return F.when(values.isNull() | (F.size(values) != 3), _arity(values, what))


def _arity(values: Column, what: str) -> Column:
    return F.concat(F.lit(f"{what}: expected 3 values, got "), F.coalesce(F.size(values).cast("string"), F.lit("null")))


def from_map(keypoints: Column, config: PoseConfig = DEFAULT) -> Column:
    """The absolute pose of map<string, array<double>>; further names are ignored, a missing one is an error."""
    error = F.raise_error(F.concat(F.lit("missing keypoints: "), F.coalesce(F.array_join(missing(keypoints, config), ", "), F.lit("all")))).cast(pose_type(config))
    built = F.struct(*(checked_vector(keypoints[name], name).alias(name) for name in config.keypoints))
    return F.when(_has_all(keypoints, config), built).otherwise(error)


def normalize(pose: Column, config: PoseConfig = DEFAULT) -> Column:
    """The pose relative to its first keypoint (the hips), which becomes exactly zero whatever it held."""
    origin = config.keypoints[0]

    def relative(name: str) -> Column:
        if name == origin:
            return vector(0.0, 0.0, 0.0)
        return F.struct(*((pose[name][a] - pose[origin][a]).alias(a) for a in AXES))

    return F.struct(*(relative(name).alias(name) for name in config.keypoints))


def coerce(df, column: str, config: PoseConfig = DEFAULT) -> Column:
    """The relative pose of a column: a struct is one already and stays as it is, a map of names is normalised."""
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.StructType) else normalize(from_map(F.col(column), config), config)


def as_map(pose: Column, config: PoseConfig = DEFAULT) -> Column:
    return F.create_map(*(x for name in config.keypoints for x in (F.lit(name), pose[name])))


def listed(pose: Column, config: PoseConfig = DEFAULT) -> Column:
    """array<struct<pos, name, x, y, z>> in keypoint order, to be exploded."""
    return F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(name).alias("name"), *(pose[name][a].alias(a) for a in AXES)) for k, name in enumerate(config.keypoints)))


def in_order(values: Column, config: PoseConfig = DEFAULT) -> Column:
    """The values of any map by keypoint, in keypoint order: array<struct<name, value>>."""
    return F.transform(F.array(*map(F.lit, config.keypoints)), lambda name: F.struct(name.alias("name"), F.try_element_at(values, name).alias("value")))


def scaled(value: Column, unit: Column | str) -> Column:
    """A length in another unit: 'm' is a hundredth, 'cm' and 'original' are as they are, any other an error."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    error = F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("null")), F.lit("; known: original, cm, m"))).cast("double")
    return F.when(unit == "m", value / 100.0).when(unit.isin("cm", "original"), value).otherwise(error)


def scaled_if_known(value: Column, unit: Column) -> Column:
    """As scaled, but an unknown unit leaves the value as it is."""
    return F.when(unit == "m", value / 100.0).otherwise(value)
