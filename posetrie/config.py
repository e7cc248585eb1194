"""Settings of the pose index: keypoints, depth, root boxes, fallback."""

from __future__ import annotations

from dataclasses import dataclass, field

AXES = ("x", "y", "z")

#: The keypoints in their order, and the joints of motion clips that they stand for.
KEYPOINTS = ("hips", "left_wrist", "right_wrist", "neck", "left_ankle", "right_ankle")
JOINT_OF = {
    "hips": "Hips",
    "left_wrist": "LeftHand",
    "right_wrist": "RightHand",
    "neck": "Neck",
    "left_ankle": "LeftFoot",
    "right_ankle": "RightFoot",
}

Box = tuple[tuple[float, float, float], tuple[float, float, float]]


@dataclass(frozen=True)
class PoseConfig:
    """keypoints decide the order of a pose's fields and of a code's digits; boxes name the roots that aren't the cube."""

    keypoints: tuple[str, ...] = KEYPOINTS
    max_depth: int = 12
    half: float = 100.0
    boxes: dict[str, Box] = field(default_factory=dict)
    fallback: str = "nearest_ancestor"

    @property
    def width(self) -> int:
        """Digits of one level's code."""
        return len(self.keypoints)

    def box(self, keypoint: str) -> Box:
        return self.boxes.get(keypoint, ((-self.half,) * 3, (self.half,) * 3))

    def is_cube(self, keypoint: str) -> bool:
        """Whether the closed form of cells holds for the keypoint's root."""
        return self.box(keypoint) == ((-100.0,) * 3, (100.0,) * 3) and self.max_depth == 12


DEFAULT = PoseConfig()
