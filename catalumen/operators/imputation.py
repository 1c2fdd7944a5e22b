"""Problem 6: missing camera models and capture times filled from similar records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.operators.lowrank import LowRank, bucket
from catalumen.operators.timestamps import READ_SQL, normalise, utc_text
from catalumen.runtime import blank, cut, skew_join, spread, table

#: Seconds from a record within which another may lend it a camera model.
NEAR = 600
#: Categorical and numeric features of the low-rank model. Models and lenses are encoded twice, independently.
MODEL, LENS = ["model", "model2"], ["lens", "lens2"]
CATEGORIES = [*MODEL, *LENS, "tree", "frame", "kind"]
NUMBERS = ["aspect", "pixels", "duration", "time"]
#: Values that are scored, and held by a task, at once.
VALUES = 20_000
#: Leading components of a path that make its tree, a feature of far fewer values than folders.
TREE = 4


def read_model(column: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space; null if there is no digit."""
    c = F.lower(F.regexp_replace(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    return F.when(column.rlike(r"(?U)\d"), c)


def cells(media: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct records with a folder: file_id, folder, stem, model, seconds and the raw features."""
    keep = ("camera_model", "lens_model", "width", "height", "duration_sec")
    rows = normalise(media, files, roots, keep=keep).filter(~blank("orig_path"))
    name = F.lower(F.element_at(F.split("orig_path", "/"), -1))
    return rows.select(
        "file_id",
        F.when(F.col("orig_path").contains("/"), F.regexp_replace("orig_path", r"(?s)/[^/]*\z", "")).otherwise("").alias("folder_path"),
        F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "").alias("stem"),
        F.regexp_extract(name, r"(?s).(\.[^.]*)\z", 1).alias("ext"),
        read_model(F.col("camera_model")).alias("camera"),
        "seconds", F.lower(F.trim("lens_model")).alias("lens_name"), "width", "height", "duration_sec",
    )


def features(rows: DataFrame) -> DataFrame:
    """Adds the encoded cells: buckets of categories, and numbers on a log scale where they span magnitudes."""
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    lens = F.when(~blank("lens_name"), F.col("lens_name"))
    return rows.withColumns(
        {
            "model": bucket(F.col("camera")),
            "model2": bucket(F.col("camera"), 1),
            "lens": bucket(lens),
            "lens2": bucket(lens, 1),
            "tree": bucket(F.substring_index("folder_path", "/", TREE)),
            "frame": bucket(F.when(sized, F.concat_ws("x", F.greatest("width", "height"), F.least("width", "height")))),
            "kind": bucket(F.col("ext")),
            "aspect": F.when(sized, F.col("width") / F.col("height")),
            "pixels": F.when(sized, F.log(F.col("width").cast("double") * F.col("height"))),
            "duration": F.when(F.col("duration_sec") >= 0, F.log1p("duration_sec")),
            "time": F.col("seconds").cast("double"),
        }
    )


def folder_choices(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(file_id, folder_path, seconds, keep..., models, source): admissible models of each record that lacks one.

    The folder's model where all its records agree (source folder); else, for records with an instant, the models of
    the folder's nearest records in time, at most NEAR seconds off (source time). Folders are reduced to their least
    and greatest model, and to one row per second, before any join; nearest records are looked for in the record's own
    and the next stretches of NEAR seconds, each of which holds at most NEAR rows of a folder.
    """
    asks = ["file_id", "folder_path", "seconds"]
    lacking = rows.filter("camera is null").select(*asks, *(keep or [])).dropDuplicates(asks)
    donors = rows.filter("camera is not null")
    folders = donors.groupBy("folder_path").agg(F.min("camera").alias("low"), F.max("camera").alias("high"))
    met = cut(skew_join(lacking, folders, ["folder_path"]))
    agreed = met.filter("low = high").select(*lacking.columns, F.array("low").alias("models"), F.lit("folder").alias("source"))

    mixed = met.filter("low <> high and seconds is not null")
    stretch = F.floor(F.col("seconds") / NEAR)
    lent = donors.filter("seconds is not null").groupBy("folder_path", "seconds").agg(F.min("camera").alias("low"), F.max("camera").alias("high"))
    lent = lent.select("folder_path", stretch.alias("stretch"), F.struct(F.col("seconds").alias("at"), "low", "high").alias("d"))
    asked = mixed.select("folder_path", "seconds").distinct().withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    by = asked.join(lent, ["folder_path", "stretch"]).filter(F.abs(F.col("d.at") - F.col("seconds")) <= NEAR)
    sides = by.groupBy("folder_path", "seconds").agg(F.max(F.when(F.col("d.at") <= F.col("seconds"), F.col("d"))).alias("before"), F.min(F.when(F.col("d.at") >= F.col("seconds"), F.col("d"))).alias("after"))
    back, ahead = F.col("seconds") - F.col("before.at"), F.col("after.at") - F.col("seconds")
    nearest = (
        F.when(F.col("after").isNull() | (back < ahead), F.array("before.low", "before.high"))
        .when(F.col("before").isNull() | (ahead < back), F.array("after.low", "after.high"))
        .otherwise(F.array("before.low", "before.high", "after.low", "after.high"))
    )
    timed = sides.select("folder_path", "seconds", F.array_distinct(nearest).alias("models"))
    near = skew_join(mixed.select(*lacking.columns), timed, ["folder_path", "seconds"]).withColumn("source", F.lit("time"))
    return agreed.unionByName(near.select(*agreed.columns))


def shot_times(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(file_id, keep..., first): the admissible instant of records without one, the earliest of the same folder and stem."""
    shots = rows.filter("seconds is not null").groupBy("folder_path", "stem").agg(F.min("seconds").alias("first"))
    asks = ["file_id", "folder_path", "stem"]
    lacking = rows.filter("seconds is null").select(*asks, *(keep or [])).dropDuplicates(asks)
    return skew_join(lacking, shots, ["folder_path", "stem"]).select("file_id", *(keep or []), "first")


def _options(models: str) -> Column:
    return F.transform(models, lambda m: F.struct(m.alias("value"), bucket(m).alias("bucket")))


def decode_in_use(model: LowRank, cells_: DataFrame, have: DataFrame, value: str, encodings: list[str], keep: list[str]) -> DataFrame:
    """keep..., value: the best of all values in use (column `value` of have) for each cell, none of them left out.

    The distinct values go to the tasks in blocks of about VALUES; with more than one block each cell keeps its best.
    """
    every = cut(have.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), *(bucket(F.col(value), i).alias(f"b{i}") for i in range(len(encodings)))).distinct())
    blocks = -(-every.count() // VALUES)
    spark = have.sparkSession
    if not blocks:
        return spark.createDataFrame([], cells_.select(*keep).schema.add("value", "string"))
    told = None
    for i in range(blocks):
        part = every.filter(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(blocks)) == i).collect()  # about VALUES rows
        if part:
            one = model.decode_among(cells_, encodings, [tuple(r) for r in part], keep)
            told = one if told is None else told.unionByName(one)
    if blocks > 1:
        told = told.groupBy(*keep).agg(F.min_by("value", F.struct(-F.col("score"), "value")).alias("value"))
    return told.select(*keep, "value")


def _cells(rows: DataFrame, field: str, value: str | Column, source: str | Column, choices: int | Column) -> DataFrame:
    given = [F.lit(x) if isinstance(x, str | int) else x for x in (source, choices)]
    return rows.select("file_id", F.lit(field).alias("field"), (F.col(value) if isinstance(value, str) else value).alias("filled"), given[0].alias("source"), given[1].alias("choices"))


def fill(rows: DataFrame, whole: bool = False, lenses: bool = False) -> DataFrame:
    """(file_id, field, filled, source, choices) of all filled cells; choices counts the admissible values, 0 for all in use.

    A low-rank model of all records' mixed cells decodes every missing model among those that its folder admits, and
    every missing instant among those that its shot admits; where one value is admissible, the model is bound to it.
    With `whole`, cells without admissible values are decoded among all models in use (source model), and missing sizes
    and durations are predicted. With `lenses`, missing lenses are decoded among all lenses in use. rows: cells(), cut.
    """
    have = cut(features(spread(rows)))  # every round reads it
    encoded = [*CATEGORIES, *NUMBERS]
    choices = cut(folder_choices(have, encoded))
    model = LowRank(CATEGORIES, NUMBERS).fit(have)
    asked = choices.select("file_id", *encoded, "source", _options("models").alias("choices"))
    out = _cells(model.decode(asked, "model", ["file_id", "source"]), "camera_model", "value", F.col("source"), F.col("choices"))
    first = F.struct(utc_text(F.col("first")).alias("value"), F.col("first").cast("double").alias("number"))
    shots = shot_times(have, encoded).select("file_id", *encoded, F.array(first).alias("choices"))
    out = out.unionByName(_cells(model.decode(shots, "time", ["file_id"]), "capture_datetime", "value", "shot", F.col("choices")))
    if whole:
        inputs = ["file_id", "folder_path", "seconds"]
        lacking = have.filter("camera is null").dropDuplicates(inputs)
        rest = lacking.join(choices, [lacking[c].eqNullSafe(choices[c]) for c in inputs], "left_anti").select("file_id", *encoded).distinct()
        out = out.unionByName(_cells(decode_in_use(model, rest, have, "camera", MODEL, ["file_id"]), "camera_model", "value", "model", 0))
    if lenses:
        bare = have.filter("lens is null").select("file_id", *encoded).distinct()
        out = out.unionByName(_cells(decode_in_use(model, bare, have.withColumn("lens_name", F.when(F.col("lens").isNotNull(), F.col("lens_name"))), "lens_name", LENS, ["file_id"]), "lens_model", "value", "model", 0))
    if whole:
        inverse = {"aspect": lambda c: c, "pixels": F.exp, "duration": F.expm1}
        names = {"aspect": "aspect_ratio", "pixels": "pixels", "duration": "duration_sec"}
        for number, back in inverse.items():
            lacks = have.filter(F.col(number).isNull()).dropDuplicates(["file_id", *CATEGORIES])
            told = model.predict(lacks.select("file_id", *encoded), number, ["file_id"])
            out = out.unionByName(_cells(told, names[number], F.round(back(F.col("value")), 3).cast("string"), "model", 0))
    return out


def held_out(rows: DataFrame, every: int = 10) -> DataFrame:
    """(source, cells, right, accuracy): known models of one file in `every` (by a hash of file_id) are hidden and filled
    again, by the rules where these force a value or leave a choice (folder, time), by the low-rank model alone else
    (model). One row more (model alone) decodes all hidden cells over all models in use. rows: cells(), cut."""
    hide = F.pmod(F.xxhash64("file_id", F.lit(3)), F.lit(every)) == 0
    truth = rows.filter(hide & F.col("camera").isNotNull()).groupBy("file_id").agg(F.min("camera").alias("camera"), F.max("camera").alias("other")).filter("camera = other")
    masked = cut(rows.withColumn("camera", F.when(~hide, F.col("camera"))))
    filled = fill(masked, whole=True).filter("field = 'camera_model'").select("file_id", "filled", "source")
    have = cut(features(spread(masked)))
    lacking = have.filter("camera is null").select("file_id", *CATEGORIES, *NUMBERS).distinct()
    alone = decode_in_use(LowRank(CATEGORIES, NUMBERS).fit(have), lacking, have, "camera", MODEL, ["file_id"])
    filled = filled.unionByName(alone.select("file_id", F.col("value").alias("filled"), F.lit("model alone").alias("source")))
    met = filled.distinct().join(truth, "file_id").groupBy("source").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("filled") == F.col("camera")).alias("right"))
    return met.withColumn("accuracy", F.col("right") / F.col("cells"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(cells(table(spark, sf_dir, "media_metadata"), table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_roots")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells as the low-rank model decodes them among their admissible values, where there is one such value.

    Nulls in any column are unknown cells; records without a usable path take no part; repeated records count once;
    ties in time must agree; empty tables give no rows; other columns are ignored.
    """
    return fill(_rows(spark, sf_dir)).filter("choices = 1").select("file_id", "field", "filled").distinct()


def p6_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells filled, each marked with where its value comes from (folder, time, shot, model).

    Of records with a usable path: aspect_ratio, pixels and duration_sec; camera_model and lens_model, if any record has
    one, decoded among all values in use where no rule gives models; capture_datetime where the same shot has a dated
    record, else it stays missing.
    """
    return fill(_rows(spark, sf_dir), whole=True, lenses=True).select("file_id", "field", "filled", "source").distinct()


def p6_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hidden camera models come back right, by the way they were filled."""
    return held_out(_rows(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_imputed": p6_imputed, "p6_accuracy": p6_accuracy}
SQL = {
    "p6_found": f"""WITH {READ_SQL},
c AS (SELECT r.file_id, CASE WHEN contains(orig_path, '/') THEN regexp_replace(orig_path, '/[^/]*$', '') ELSE '' END AS folder, lower(regexp_extract(orig_path, '[^/]*$', 0)) AS n, seconds,
    CASE WHEN regexp_matches(camera_model, '[0-9]') THEN lower(regexp_replace(regexp_replace(camera_model, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) END AS camera
  FROM read r JOIN files f ON f.id = r.file_id WHERE regexp_matches(orig_path, '\\S')),
x AS (SELECT DISTINCT *, CASE WHEN regexp_matches(n, '^.+\\.[^.]*$') THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END AS stem FROM c),
fo AS (SELECT folder, min(camera) AS low, max(camera) AS high FROM x WHERE camera IS NOT NULL GROUP BY folder),
near AS (SELECT a.folder, a.seconds, abs(b.seconds - a.seconds) AS d, min(b.camera) AS low, max(b.camera) AS high
  FROM (SELECT DISTINCT folder, seconds FROM x WHERE camera IS NULL AND seconds IS NOT NULL) a JOIN x b ON a.folder = b.folder AND b.camera IS NOT NULL AND abs(b.seconds - a.seconds) <= {NEAR}
  GROUP BY a.folder, a.seconds, abs(b.seconds - a.seconds) QUALIFY row_number() OVER (PARTITION BY a.folder, a.seconds ORDER BY abs(b.seconds - a.seconds)) = 1),
shot AS (SELECT folder, stem, min(seconds) AS first FROM x WHERE seconds IS NOT NULL GROUP BY folder, stem)
SELECT DISTINCT file_id, 'camera_model' AS field, low AS filled FROM x JOIN fo USING (folder) WHERE camera IS NULL AND low = high
UNION SELECT file_id, 'camera_model', near.low FROM x JOIN fo USING (folder) JOIN near USING (folder, seconds) WHERE camera IS NULL AND fo.low <> fo.high AND near.low = near.high
UNION SELECT file_id, 'capture_datetime', strftime(make_timestamp(first * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM x JOIN shot USING (folder, stem) WHERE seconds IS NULL""",
}
