"""Motion clips of this library's own skeleton: a small one for tests and examples, and clips of given frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posetrie.sources.model import new_folder

#: (name, offset, children); None is an end site. The first branch ends before its sibling begins.
_SKELETON = (
    "Hips",
    (0, 0, 0),
    [
        ("Spine", (0, 4, 0), [("Neck", (0, 3, 0.5), [(None, (0, 2, 0), [])]), ("LeftArm", (2, 1, 0), [("LeftHand", (3, 0, 0), [(None, (1, 0, 0), [])])]), ("RightArm", (-2, 1, 0), [("RightHand", (-3, 0, 0), [(None, (-1, 0, 0), [])])])]),
        ("LeftLeg", (1, -1, 0), [("LeftFoot", (0.5, -7, 0), [(None, (0, -1, 1), [])])]),
        ("RightLeg", (-1, -1, 0), [("RightFoot", (-0.5, -7, 0), [(None, (0, -1, 1), [])])]),
    ],
)


def text(frames: int = 3) -> str:
    """The clip; frame f turns joint j by small multiples of f and j on all axes."""
    lines, joints = ["HIERARCHY"], 0

    def add(node, kind, pad):
        nonlocal joints
        name, offset, children = node
        lines.extend([f"{pad}{kind} {name}" if name else f"{pad}End Site", pad + "{", f"{pad}\tOFFSET {' '.join(f'{x:.5f}' for x in offset)}"])
        if name:
            joints += 1
            lines.append(f"{pad}\tCHANNELS " + ("6 Xposition Yposition Zposition " if kind == "ROOT" else "3 ") + "Zrotation Yrotation Xrotation")
        for child in children:
            add(child, "JOINT", pad + "\t")
        lines.append(pad + "}")

    add(_SKELETON, "ROOT", "")
    lines += ["MOTION", f"Frames: {frames}", "Frame Time: .0083333"]
    for f in range(frames):
        lines.append(" ".join([f"{f}.5", "17.25", "-0.0", *(f"{((j * 7 + f * 3) % 11 - 5) * f * 2.5:.4f}" for j in range(3 * joints))]))
    return "\r\n".join(lines[:2]) + "\n" + "\n".join(lines[2:]) + "\n"


def example(spark: SparkSession, frames: int = 3) -> str:
    """A folder with the clip."""
    path = new_folder(spark, "clip")
    spark.createDataFrame([(text(frames),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


def documents(frames: DataFrame) -> DataFrame:
    """(clip, value): the text of each clip of frames (clip, frame_index, values).

    values: as many numbers as the skeleton has channels. A clip is one document, and its frames come
    together in one row; clips of a bounded number of frames are the caller's to make.
    """
    header = text(0).split("Frames:")[0]
    row = F.struct("frame_index", F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("row"))
    whole = frames.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]).alias("rows"))
    head = F.concat(F.lit(f"{header}Frames: "), F.size("rows").cast("string"), F.lit("\nFrame Time: .0083333\n"))
    return whole.select("clip", F.concat(head, F.array_join("rows", "\n")).alias("value"))


def write(frames: DataFrame, path: str) -> None:
    """Writes documents() of frames, one file a clip, in folders clip=<clip> of path."""
    documents(frames).write.option("lineSep", "\n").partitionBy("clip").text(path)
