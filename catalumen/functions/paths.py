"""Path and name expressions. All are built-in column expressions; a null input gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.constants import CAMERA_NAMES, EXTENSIONS


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def parent(path: Column) -> Column:
    """The path before its last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).when(path.isNotNull(), "")


def suffix(name: Column) -> Column:
    """The last extension with its dot; empty for dot files and names that end in a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    return F.when(name.isNotNull(), F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name))))


def file_type(name: Column, resource_forks: bool = True) -> Column:
    """raw, jpeg, video, psd, tiff, sidecar or other, by extension; ._ names are other unless `resource_forks` is off."""
    ext = F.lower(suffix(name))
    kind = F.when(name.startswith("._"), "other") if resource_forks else F.when(F.lit(False), "other")
    for k, exts in EXTENSIONS.items():
        kind = kind.when(ext.isin(exts), k)
    return kind.when(name.isNotNull(), "other")


def within(path: Column, root: Column) -> Column:
    """Whether path is root or lies under it, by whole components."""
    base = F.regexp_replace(root, "/+$", "")
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def outside(listing: DataFrame, skips: DataFrame, path: str = "path", skip: str = "skip_dir") -> DataFrame:
    """Rows of the listing that lie under none of the skipped directories.

    Joined on each directory above the path, so that any number of skipped directories is one equi anti join; null
    paths are kept, blank skips ignored.
    """
    bare = skips.select(F.regexp_replace(skip, "/+$", "").alias("_skip")).filter("_skip <> ''").distinct()
    parts = F.split(F.col(path), "/")
    # the path itself counts too
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = listing.select(path).distinct().withColumn("_skip", F.explode(above)).join(bare, "_skip", "left_semi").select(path).distinct()
    return listing.join(hit, path, "left_anti")


def nested(directories: DataFrame, name: str = "skip_dir") -> DataFrame:
    """Those of the directories that lie in another of them, by whole components and whatever slashes end them."""
    bare = directories.filter(F.col(name) != "").select(name, F.regexp_replace(name, "/+$", "").alias("_bare"))
    parts = F.split("_bare", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = bare.filter(F.col("_bare").contains("/")).withColumn("_above", F.explode(above))
    return inner.join(bare.select(F.col("_bare").alias("_above")).distinct(), "_above", "left_semi").select(name).distinct()


def clean_path(path: Column) -> Column:
    """Outer blanks and quotes off, doubled and trailing slashes and /./ folded; the empty path is '.'."""
    p = F.regexp_replace(path, r"^\s+|\s+$", "")
    p = F.btrim(F.btrim(p, F.lit('"')), F.lit("'"))
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(^|/)(\./)+", "$1")
    p = F.regexp_replace(p, r"(.)/\.?\z", "$1")
    return F.when(p == "", ".").otherwise(p)


def _points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def name_score(stem_: Column, dialect: str = "v2") -> Column:
    """How descriptive a name is: camera names and copies lose, words gain; v1 also rewards length."""
    s = F.lower(stem_)
    camera = F.lit(False)
    for p in CAMERA_NAMES:
        camera = camera | s.rlike(p.replace("$", r"\z"))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(s, r"[^\p{Nd}]", ""))
    copy = s.contains("copy") if dialect == "v2" else s.rlike(r"(?U)\bcopy\b")
    score = _points(camera, -5) + _points(copy, -4) + _points(s.contains(" "), 2) + _points(s.contains("-") | s.contains("_"), 1) + _points(letters > digits, 2)
    return F.when(s.isNotNull(), score if dialect == "v2" else score + _points(F.length(s) >= 12, 1))


def normal_stem(stem_: Column, dialect: str = "v2") -> Column:
    """The stem that a picture and its copies share; v1 also drops _edit and -edit."""
    s = F.regexp_replace(F.lower(stem_), r"^\s+|\s+$", "")
    endings = [r"\(copy\)\z", r"_copy\z"] + ([r"_edit\z", r"-edit\z"] if dialect == "v1" else []) + [r"\(\d+\)\z"]
    for e in endings:
        s = F.regexp_replace(s, e, "")
    return F.btrim(s, F.lit("_- "))


def psd_stem(stem_: Column, dialect: str = "v2") -> Column:
    """The normal stem of the picture that a layered document was made from."""
    words = "edit|final|v\\d+|copy|retouched" + ("|variant|working" if dialect == "v1" else "")
    s = F.regexp_replace(normal_stem(stem_, dialect), rf"[-_]({words})\z", "")
    return F.regexp_replace(s, r"\s*\(\d+\)\z", "") if dialect == "v1" else s


def digit_core(stem_: Column) -> Column:
    return F.regexp_replace(stem_, r"[^0-9]", "")


def shorten(value: Column) -> Column:
    """Values of more than 60 characters as their first 57 and three dots."""
    return F.when(F.length(value) > 60, F.concat(F.substring(value, 1, 57), F.lit("..."))).otherwise(value)
