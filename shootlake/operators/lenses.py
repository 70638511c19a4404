"""Matching photos to lens and camera calibration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Built-in nicknames of adapted lenses with their profile, focal reducer and crop factor.
BUILT_IN_ALIASES = [
    ("Ultron 0.7x", "Voigtlander Ultron 40mm f/2 SLII Aspherical", 0.71, 2.0),
    ("Zeiss Planar", "Carl Zeiss Makro-Planar T* 2/50 ZF.2", 1.0, 2.0),
    ("Zeiss Planar 0.7x", "Carl Zeiss Makro-Planar T* 2/50 ZF.2", 0.71, 2.0),
]
# Accepted reducers and crop factors, shortest name matched in part, focal slack.
REDUCER, CROP, PART, SLACK = (0.1, 2.0), (0.1, 10.0), 5, 0.1


def normalised(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def names_match(asked: Column, candidate: Column) -> Column:
    """Both normalised: equal, or the candidate has five letters or more and one contains the other."""
    part = (F.length(candidate) >= PART) & (F.contains(candidate, asked) | F.contains(asked, candidate))
    return (candidate == asked) | part


def alias_problems(nickname: Column, model: Column, reducer: Column, crop: Column) -> Column:
    return F.array_compact(F.array(
        F.when(nickname.isNull(), F.lit("nickname")), F.when(F.coalesce(model, F.lit("")) == "", F.lit("model")),
        F.when(~F.coalesce(reducer.between(*REDUCER), F.lit(True)), F.lit("reducer")),
        F.when(~F.coalesce(crop.between(*CROP), F.lit(False)), F.lit("crop"))))


def with_built_in(user: DataFrame) -> DataFrame:
    """User aliases (nickname, model, focal_reducer, crop_factor, seq) ahead of the built-in ones."""
    spark = user.sparkSession
    built = spark.createDataFrame([(*a, i) for i, a in enumerate(BUILT_IN_ALIASES)],
                                  "nickname string, model string, focal_reducer double, crop_factor double, seq long")
    return user.withColumn("priority", F.lit(0)).unionByName(built.withColumn("priority", F.lit(1)))


def resolve_alias(photos: DataFrame, aliases: DataFrame, name: str = "lens_description") -> DataFrame:
    """Add alias_model, focal_reducer (1 by default) and alias_crop; case aside, first alias wins."""
    first = aliases.groupBy(F.lower("nickname").alias("_nick")).agg(F.min_by(F.struct(
        F.col("model").alias("alias_model"), F.coalesce("focal_reducer", F.lit(1.0)).alias("focal_reducer"),
        F.col("crop_factor").alias("alias_crop")), F.struct("priority", "seq")).alias("_a"))
    joined = photos.withColumn("_nick", F.lower(name)).join(first, "_nick", "left")
    return joined.select(*photos.columns, "_a.alias_model", "_a.focal_reducer", "_a.alias_crop")


def effective_name(own: Column, catalogued: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), catalogued, F.lit(""))


def _matches(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, name): pairs of normalised names that match, without comparing every pair.

    A name that contains another holds its first PART letters somewhere, so both sides meet in one join on the letters that a
    match must share: the whole name, the first letters of the one and any slice of the other, or, for names asked that are shorter
    than a candidate's least, slices of their own length (an empty name lies inside every candidate). What meets is then
    checked in full.
    """
    def slices(c: str, n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                                                    lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array())

    def keyed(df: DataFrame, whole: str, **keys: Column) -> DataFrame:
        """One row for each different key; a letter in front tells what a key stands for."""
        def tagged(letter: str) -> Column:
            return F.transform(keys[letter], lambda v: F.concat(F.lit(letter), v))
        return df.where(F.col(whole).isNotNull()).withColumn("_g", F.explode(F.array_distinct(F.concat(*map(tagged, keys)))))

    def long(c: str, keys: Column) -> Column:
        return F.when(F.length(c) >= PART, keys).otherwise(F.array())

    first = lambda c: F.array(F.substring(c, 1, PART))
    short = F.when(F.length("asked") < PART, F.array("asked")).otherwise(F.array())
    left = keyed(asked, "asked", e=F.array("asked"), a=long("asked", first("asked")), i=slices("asked", PART), s=short)
    right = keyed(names, "name", e=F.array("name"), a=slices("name", PART), i=long("name", first("name")),
                  s=long("name", F.concat(F.array(F.lit("")), *[slices("name", n) for n in range(1, PART)])))
    return left.join(right, "_g").where(names_match(F.col("asked"), F.col("name"))).select("asked", "name").distinct()


def match_camera(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """Add the first camera row (by `seq`) whose maker and model both match, or nulls.

    `photos` has make and model, `cameras` (seq, maker, model, mount, crop_factor). Distinct names
    are matched once, then photos join by equality.
    """
    asked = photos.select(normalised(F.col("make")).alias("make_n"), normalised(F.col("model")).alias("model_n")).distinct()
    known = cameras.select("seq", "mount", "crop_factor", normalised(F.col("maker")).alias("_maker"), normalised(F.col("model")).alias("_model"))
    models = _matches(asked.select(F.col("model_n").alias("asked")).distinct(), known.select(F.col("_model").alias("name")).distinct())
    pairs = asked.join(models, F.col("model_n") == F.col("asked")).join(known, F.col("_model") == F.col("name")).where(
        names_match(F.col("make_n"), F.col("_maker")))
    best = pairs.groupBy("make_n", "model_n").agg(F.min_by(F.struct(
        F.col("seq").alias("camera"), F.col("mount").alias("camera_mount"), F.col("crop_factor").alias("camera_crop")), "seq").alias("_c"))
    tagged = photos.withColumns({"make_n": normalised(F.col("make")), "model_n": normalised(F.col("model"))})
    return tagged.join(best, ["make_n", "model_n"], "left").select(*photos.columns, "_c.camera", "_c.camera_mount", "_c.camera_crop")


def _in_window(focal: Column) -> Column:
    return (((F.col("focal_min") <= 0) | (focal >= F.col("focal_min") - SLACK))
            & ((F.col("focal_max") <= 0) | (focal <= F.col("focal_max") + SLACK)))


def compatible_mounts(mounts: DataFrame) -> DataFrame:
    """(camera_mount, lens_mount) pairs from (mount, compatible), every mount fitting itself; lower case."""
    one = mounts.select(F.lower("mount").alias("camera_mount"), F.lower("compatible").alias("lens_mount"))
    return one.unionByName(one.select("camera_mount", F.col("camera_mount").alias("lens_mount"))).distinct()


def match_lens(photos: DataFrame, lenses: DataFrame, mounts: DataFrame) -> DataFrame:
    """Add the best lens row: mount fits, focal in its window, name matches; longest name wins, an
    exact one by two more, the last listed on a tie.

    `photos` has lens_name, focal, camera_mount; `lenses` (seq, model, mount, focal_min, focal_max).
    """
    keys = ["_asked", "focal", "_cm"]
    tagged = photos.withColumns({"_asked": normalised(F.col("lens_name")), "_cm": F.lower("camera_mount")})
    asked = tagged.where("_cm IS NOT NULL").select(*keys).distinct()
    known = lenses.select("seq", "focal_min", "focal_max", F.lower("mount").alias("_lm"), normalised(F.col("model")).alias("_name"))
    # rows alike but for their place never win against the last of them
    known = known.groupBy("_name", "_lm", "focal_min", "focal_max").agg(F.max("seq").alias("seq"))
    named = _matches(asked.select(F.col("_asked").alias("asked")).distinct(), known.select(F.col("_name").alias("name")).distinct())
    # of a name's rows that hold a focal, only the last of each mount can win: one row for them, found without the names asked
    wanted = asked.join(named, F.col("_asked") == F.col("asked")).select("name", "focal").distinct()
    last = wanted.join(known, F.col("_name") == F.col("name")).where(_in_window(F.col("focal"))).groupBy("_name", "focal", "_lm").agg(F.max("seq").alias("seq"))
    pairs = asked.join(named, F.col("_asked") == F.col("asked")).withColumnRenamed("name", "_name").join(last, ["_name", "focal"])
    free = F.coalesce(F.col("_lm"), F.lit("")) == ""
    fits = compatible_mounts(mounts)
    own = pairs.where(free | (F.col("_lm") == F.col("_cm")))
    lent = pairs.where(~free & (F.col("_lm") != F.col("_cm"))).join(
        fits, (F.col("_cm") == F.col("camera_mount")) & (F.col("_lm") == F.col("lens_mount")), "left_semi")
    score = F.struct((F.length("_name") + F.when(F.col("_name") == F.col("_asked"), 2).otherwise(0)).alias("score"), "seq")
    best = own.unionByName(lent).groupBy(*keys).agg(F.max(score).alias("_b"))
    return tagged.join(best, keys, "left").select(*photos.columns, F.col("_b.seq").alias("lens"), F.col("_b.score").alias("lens_score"))


def match_explicit(photos: DataFrame, lenses: DataFrame) -> DataFrame:
    """Add the lens row whose normalised model equals `alias_model` and whose window holds the focal."""
    known = lenses.select("seq", "focal_min", "focal_max", normalised(F.col("model")).alias("_name"))
    asked = photos.select("alias_model", "profile_focal").distinct().withColumn("_name", normalised(F.col("alias_model")))
    best = asked.join(known, "_name").where(_in_window(F.col("profile_focal"))).groupBy("alias_model", "profile_focal").agg(F.max("seq").alias("lens"))
    return photos.join(best, ["alias_model", "profile_focal"], "left").select(*photos.columns, "lens")


def adapted_geometry(photos: DataFrame) -> DataFrame:
    """Add profile_focal, profile_crop and `geometry_ok`, from the reducer and the crop known."""
    reducer = F.coalesce("focal_reducer", F.lit(1.0))
    crop = F.when(F.col("alias_crop") > 0, F.col("alias_crop")).otherwise(F.col("camera_crop"))
    return photos.withColumns({"profile_focal": F.col("focal") / reducer, "profile_crop": crop * reducer,
                               "geometry_ok": crop.isNotNull() & (F.col("focal") > 0)})


def fall_back(matched: DataFrame, wants_optics: Column) -> DataFrame:
    """Switch optics off, with a warning, for photos that want it but match no lens."""
    missing = wants_optics & F.col("lens").isNull()
    return matched.withColumns({"optics": wants_optics & ~missing, "warning": F.when(missing, F.lit("no lens profile"))})
