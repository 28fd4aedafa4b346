"""Axis orientations: codes from affines, and images and gradients turned to another code.

A code has one letter per axis, each the direction that the axis points to:
L or R, A or P, S or I.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which anatomical axis a letter lies on, and whether it points to its positive end.
_LETTER = {"L": (0, False), "R": (0, True), "P": (1, False), "A": (1, True), "I": (2, False), "S": (2, True)}


def is_valid(code: Column) -> Column:
    """Whether a code has three letters, one of each pair."""
    up = F.upper(code)
    return F.coalesce(up.rlike("^[LRAPSI]{3}$") & up.rlike("[LR]") & up.rlike("[AP]") & up.rlike("[SI]"), F.lit(False))


def of_affine(affine: Column) -> Column:
    """The code of a 4 x 4 affine given by rows: each axis goes to the direction in which it moves most."""
    size = lambda r, c: F.abs(affine[4 * r + c])

    def letter(axis: int) -> Column:
        most = F.greatest(*[size(r, axis) for r in range(3)])
        pairs = [("L", "R"), ("P", "A"), ("I", "S")]
        names = [F.when(affine[4 * r + axis] < 0, F.lit(low)).otherwise(F.lit(high)) for r, (low, high) in enumerate(pairs)]
        return F.when(size(0, axis) == most, names[0]).when(size(1, axis) == most, names[1]).otherwise(names[2])

    return F.concat(*[letter(a) for a in range(3)])


def steps(old: str, new: str) -> list[tuple[int, bool]]:
    """For each new axis the old axis that it is, and whether it is reversed."""
    for code in (old, new):
        if len(code) != 3 or {_LETTER.get(x, (9,))[0] for x in code.upper()} != {0, 1, 2}:
            raise ValueError(f"not an orientation: {code}")
    found = []
    for x in new.upper():
        at = [_LETTER[y][0] for y in old.upper()].index(_LETTER[x][0])
        found.append((at, _LETTER[old.upper()[at]][1] != _LETTER[x][1]))
    return found


def reorient(img: DataFrame, old: str, new: str, shape: dict[str, int]) -> DataFrame:
    """Voxels at their places in the new orientation; sparse voxels only move."""
    sizes = [shape[a] for a in "ijk"]
    moved = {}
    for axis, (at, flipped) in zip("ijk", steps(old, new), strict=True):
        place = F.col("ijk"[at])
        moved[axis] = ((sizes[at] - 1 - place) if flipped else place).cast("int")
    return img.withColumns(moved)


def reorient_gradients(gradients: DataFrame, old: str, new: str) -> DataFrame:
    """Gradient directions along the new axes."""
    names = ["bx", "by", "bz"]
    turned = [(-F.col(names[at]) if flipped else F.col(names[at])) + F.lit(0.0) for at, flipped in steps(old, new)]
    return gradients.withColumns(dict(zip(names, turned, strict=True)))


def flip_gradients(gradients: DataFrame, axes: list[str]) -> DataFrame:
    """Negates components; adding 0 makes no negative zero."""
    return gradients.withColumns({c: -F.col(c) + F.lit(0.0) for c in axes})
