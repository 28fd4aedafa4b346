"""File-name and text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_ext(path: Column) -> Column:
    """Without the last extension; two go if the last is gz or bz2."""
    return F.regexp_replace(path, r"(\.[^./]+)?\.(gz|bz2)$|\.[^./]+$", "")


def image_ext(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.nii\.gz|\.nii|\.hdr|\.img)$", 1)


def has_image_ext(path: Column) -> Column:
    return path.rlike(r"(\.nii\.gz|\.nii|\.hdr|\.img)$")


def image_prefix(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.nii\.gz|\.nii|\.hdr|\.img)$", "")


def expand_template(template: str, subject: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{s}"), subject.cast("string"))


def roi_name(label: Column, name: Column, width: int) -> Column:
    return F.concat(F.lit("r"), F.lpad(label.cast("string"), width, "0"), F.lit("_"), name)


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def parse_time(text: Column) -> Column:
    """HHMMSS with or without a fraction, as seconds of the day."""
    digits = F.regexp_extract(text, r"^(\d{6})(\.\d+)?$", 1)
    part = lambda at: F.try_to_number(F.nullif(F.substring(digits, at, 2), F.lit("")), F.lit("99")).cast("int")
    return part(1) * 3600 + part(3) * 60 + part(5)


def sidecars(files: DataFrame, contain: list[str] | None = None) -> DataFrame:
    """Images of a listing (path) with the paths of their sidecars, null where there is none: path, stem, bval, bvec, json.

    With ``contain`` those images alone whose name holds one of the strings.
    """
    named = files.select("path", image_ext(F.col("path")).alias("ext"), F.regexp_replace("path", r"(\.nii\.gz|\.nii|\.hdr|\.img|\.bval|\.bvec|\.json)$", "").alias("stem"))
    kinds = named.groupBy("stem").agg(*[F.max(F.when(F.col("path").endswith("." + k), F.col("path"))).alias(k) for k in ("bval", "bvec", "json")])
    images = named.where("ext <> ''")
    if contain is not None:
        name = F.element_at(F.split("path", "/"), -1)
        images = images.where(F.exists(F.array(*map(F.lit, contain)), lambda x: F.contains(name, x)))
    return images.join(kinds, "stem").select("path", "stem", "bval", "bvec", "json")


def ambiguous_images(files: DataFrame) -> DataFrame:
    """Stems of a listing (path) that several images share, or none: stem, n."""
    named = files.select(F.regexp_replace("path", r"(\.nii\.gz|\.nii|\.hdr|\.img|\.bval|\.bvec|\.json)$", "").alias("stem"), F.col("path").rlike(r"(\.nii\.gz|\.nii|\.hdr)$").cast("int").alias("image"))
    return named.groupBy("stem").agg(F.sum("image").alias("n")).where("n <> 1")


def is_affine_text(text: Column) -> Column:
    """Whether a text is a 4 x 4 matrix whose last row is 0 0 0 1."""
    lines = F.filter(F.split(F.trim(text), r"\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"[ \t\r]+"), lambda y: y.try_cast("double")))
    square = (F.size(rows) == 4) & F.forall(rows, lambda r: (F.size(r) == 4) & F.forall(r, lambda y: y.isNotNull()))
    return F.coalesce(square & (F.get(rows, F.lit(3)) == F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))), F.lit(False))
