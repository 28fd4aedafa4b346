"""Diffusion tensors as struct columns: closed-form eigenvalues and scalar maps, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENSOR = ("xx", "xy", "yy", "xz", "yz", "zz")


def eigenvalues(t: DataFrame) -> DataFrame:
    """Adds l1 >= l2 >= l3 of the symmetric tensor, by the trigonometric form."""
    xx, xy, yy, xz, yz, zz = (F.col(c) for c in TENSOR)
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy**2 + xz**2 + yz**2)) / 6)
    out = t.withColumn("q", q).withColumn("p", p)
    a, b, c = xx - F.col("q"), yy - F.col("q"), zz - F.col("q")
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * F.col("p") ** 3)))
    out = out.withColumn("phi", F.when(F.col("p") == 0, 0.0).otherwise(F.acos(r) / 3))
    l1 = F.col("q") + 2 * F.col("p") * F.cos("phi")
    l3 = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * 3.141592653589793 / 3)
    return out.withColumn("l1", l1).withColumn("l3", l3).withColumn("l2", 3 * F.col("q") - F.col("l1") - F.col("l3")).drop("q", "p", "phi")


def scalars(t: DataFrame) -> DataFrame:
    """FA, MD, TR, AX, RAD, CL, CP and CS; ratios of an empty tensor are 0."""
    e = eigenvalues(t)
    l1, l2, l3 = (F.col(c) for c in ("l1", "l2", "l3"))
    tr = l1 + l2 + l3
    ratio = lambda x: F.coalesce(F.try_divide(x, tr), F.lit(0.0))
    fa = F.sqrt(F.coalesce(F.try_divide(0.5 * ((l1 - l2) ** 2 + (l2 - l3) ** 2 + (l3 - l1) ** 2), l1**2 + l2**2 + l3**2), F.lit(0.0)))
    return e.select(*[c for c in t.columns if c not in TENSOR], "l1", "l2", "l3", fa.alias("fa"), (tr / 3).alias("md"), tr.alias("tr"), l1.alias("ax"), ((l2 + l3) / 2).alias("rad"), ratio(l1 - l2).alias("cl"), ratio(2 * (l2 - l3)).alias("cp"), ratio(3 * l3).alias("cs"))


def eigenvectors(t: DataFrame) -> DataFrame:
    """Adds v1, v2, v3, unit vectors of l1 >= l2 >= l3, each with its largest component positive.

    The vector of a single eigenvalue is the longest cross product of two rows
    of the tensor less that value; where eigenvalues are equal, any vector at
    right angles to the others serves.
    """
    e = eigenvalues(t)
    xx, xy, yy, xz, yz, zz = (F.col(c) for c in TENSOR)
    let = lambda value, body: F.transform(F.array(value), body)[0]
    vec = lambda *c: F.array(*c)
    cross = lambda a, b: vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    unit = lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / n))

    def signed(v: Column) -> Column:
        top = F.array_max(F.transform(v, F.abs))
        return F.when(F.exists(v, lambda x: x == top), v).otherwise(F.transform(v, lambda x: -x))

    def of(l: Column) -> Column:
        rows = [vec(xx - l, xy, xz), vec(xy, yy - l, yz), vec(xz, yz, zz - l)]
        products = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
        longest = F.array_max(F.array(*[F.struct(dot(p, p).alias("n"), p.alias("v")) for p in products]))
        scale = xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
        return let(longest, lambda x: F.when(x["n"] > 1e-24 * scale * scale, unit(x["v"])))

    def beside(v: Column) -> Column:
        axis = F.when((F.abs(v[0]) <= F.abs(v[1])) & (F.abs(v[0]) <= F.abs(v[2])), vec(*map(F.lit, (1.0, 0.0, 0.0)))).when(F.abs(v[1]) <= F.abs(v[2]), vec(*map(F.lit, (0.0, 1.0, 0.0)))).otherwise(vec(*map(F.lit, (0.0, 0.0, 1.0))))
        return unit(cross(v, axis))

    first = e.withColumn("v1", of(F.col("l1"))).withColumn("v3", of(F.col("l3")))
    # Of two equal values either has no vector of its own; three equal ones have none at all.
    first = first.withColumn("v1", F.coalesce("v1", F.when(F.col("v3").isNotNull(), beside(F.col("v3"))).otherwise(vec(*map(F.lit, (1.0, 0.0, 0.0))))))
    first = first.withColumn("v3", F.coalesce("v3", beside(F.col("v1"))))
    out = first.withColumn("v2", unit(cross(F.col("v3"), F.col("v1"))))
    return out.withColumns({v: signed(F.col(v)) for v in ("v1", "v2", "v3")})


def colormap(t: DataFrame) -> DataFrame:
    """Red, green and blue from 0 to 255: the first eigenvector's absolute components times FA."""
    v = eigenvectors(t).withColumn("fa", F.sqrt(F.coalesce(F.try_divide(0.5 * ((F.col("l1") - F.col("l2")) ** 2 + (F.col("l2") - F.col("l3")) ** 2 + (F.col("l3") - F.col("l1")) ** 2), F.col("l1") ** 2 + F.col("l2") ** 2 + F.col("l3") ** 2), F.lit(0.0))))
    shade = lambda n: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fa"))) * F.abs(F.col("v1")[n]) * 255).cast("int")
    return v.select(*[c for c in t.columns if c not in TENSOR], shade(0).alias("red"), shade(1).alias("green"), shade(2).alias("blue"))


def to_factors(t: DataFrame) -> DataFrame:
    """Tensors as the factors of their triangular form: three scales w1, w2, w3 and three shears w4, w5, w6.

    A scale of 0 has no shear; such a tensor is brought back without what the
    shear would hold.
    """
    xx, xy, yy, xz, yz, zz = (F.col(c) for c in TENSOR)
    over = lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, F.nullif(y, F.lit(0.0))))
    first = t.withColumn("w1", xx).withColumn("w4", over(xy, xx)).withColumn("w5", over(xz, xx)).withColumn("w2", yy - over(xy * xy, xx))
    # The determinant of the upper block decides whether the last shear exists.
    last = F.when(xx == 0, over(yz, yy)).otherwise(over(xx * yz - xy * xz, xx * yy - xy * xy))
    second = first.withColumn("w6", last)
    return second.withColumn("w3", zz - F.col("w1") * F.col("w5") ** 2 - F.col("w2") * F.col("w6") ** 2).drop(*TENSOR)


def from_factors(t: DataFrame) -> DataFrame:
    """Tensors from their factors."""
    w1, w2, w3, w4, w5, w6 = (F.col(f"w{n}") for n in range(1, 7))
    made = {"xx": w1, "xy": w1 * w4, "yy": w2 + w1 * w4 * w4, "xz": w1 * w5, "yz": w1 * w4 * w5 + w2 * w6, "zz": w3 + w1 * w5 * w5 + w2 * w6 * w6}
    return t.withColumns(made).drop(*[f"w{n}" for n in range(1, 7)])


def clip_eigenvalues(t: DataFrame, low: float, high: float) -> DataFrame:
    """Tensors whose eigenvalues are held between the bounds, with their vectors as they are."""
    e = eigenvectors(t)
    held = {k: F.least(F.greatest(F.col(f"l{k}"), F.lit(low)), F.lit(high)) for k in (1, 2, 3)}
    places = {"xx": (0, 0), "xy": (0, 1), "yy": (1, 1), "xz": (0, 2), "yz": (1, 2), "zz": (2, 2)}
    product = lambda a, b: held[1] * F.col("v1")[a] * F.col("v1")[b] + held[2] * F.col("v2")[a] * F.col("v2")[b] + held[3] * F.col("v3")[a] * F.col("v3")[b]
    return e.select(*[c for c in t.columns if c not in TENSOR], *[product(a, b).alias(c) for c, (a, b) in places.items()])


def free_water_fraction(signal: Column, b0: Column, md: Column, b: float, wm_b0: float, csf_b0: float, water: float = 3e-3) -> Column:
    """First estimate of the tissue fraction from the b = 0 signal and the mean diffusivity."""
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    f0 = clip(1 - F.log(b0 / wm_b0 + 1e-12) / F.log(F.lit(csf_b0 / wm_b0)), 0.0, 1.0)
    decay = F.exp(F.lit(-b * water))
    f_md = clip((F.exp(-b * md) - decay) / (F.exp(F.lit(-b * 0.6e-3)) - decay), 0.01, 0.99)
    return clip(F.pow(clip(f0, 0.0, 1.0), 1 - f0) * F.pow(f_md, f0), 0.05, 0.99)


def correct_signal(signal: Column, b0: Column, fraction: Column, b: float, water: float = 3e-3, most: float = 0.95) -> Column:
    """Signal without free water of the given volume fraction; 0 where that exceeds ``most``."""
    attenuated = F.try_divide(F.try_divide(signal, b0) - fraction * F.exp(F.lit(-b * water)), 1 - fraction)
    return F.when(fraction > most, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(attenuated * b0 * (1 - fraction), F.lit(0.0))))
