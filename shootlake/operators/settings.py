"""Photo settings: defaults overlaid by overrides, stages switched off, grades copied between photos.

A setting map keeps "present but null" apart from "absent", which a wide row cannot. Every operator
here is a projection over one photo row, or a join of photos with their project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.functions import recipe_kinds as R
from shootlake.functions.settings_keys import (DEFAULTS, EXECUTION_ORDER, FLAGS, IDENTITY, KEYS, RANGES,
                                               RENDER_RANGES, STAGES, TEXTS)
from shootlake.sources.tables import NODE, RECIPE, SETTING, SETTINGS


def setting(key: str, value: Column | float | bool | str | None) -> Column:
    field = "flag" if key in FLAGS else "text" if key in TEXTS else "num"
    parts = [(value if isinstance(value, Column) else F.lit(value)) if f == field else F.lit(None)
             for f in ("num", "flag", "text")]
    return F.struct(*[p.alias(f) for p, f in zip(parts, ("num", "flag", "text"))]).cast(SETTING)


def _constant(values: dict) -> Column:
    return F.create_map(*[part for k in KEYS for part in (F.lit(k), setting(k, values.get(k, 0.0)))])


def defaults(**changed: Column | float | str | None) -> Column:
    return _constant({**DEFAULTS, **changed})


def identity() -> Column:
    return _constant(IDENTITY)


def empty() -> Column:
    return F.expr(f"cast(map() as {SETTINGS})")


def overlay(base: Column, top: Column) -> Column:
    """`top` wins per key, also where its value is null."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def effective(defaults_: Column, overrides: Column) -> Column:
    """A complete setting map with the overrides on top; present-but-null overrides count."""
    chosen = [F.when(F.map_contains_key(overrides, k), F.element_at(overrides, k)).otherwise(F.element_at(defaults_, k)) for k in KEYS]
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in KEYS]), F.array(*chosen))
    return F.when(F.size(overrides) == 0, defaults_).otherwise(whole)


def bypass(settings: Column, disabled: Column) -> Column:
    """Complete settings whose switched-off stages hold their identity values."""
    held = [F.when(F.array_contains(disabled, stage), setting(k, IDENTITY.get(k, 0.0))).otherwise(F.element_at(settings, k))
            for stage, keys in STAGES.items() for k in keys]
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in KEYS]), F.array(*held))
    return F.when(F.size(disabled) == 0, settings).otherwise(whole)


def with_effective(photos: DataFrame, projects: DataFrame) -> DataFrame:
    """Add `effective` and `rendered` settings. One project row meets many photos: Spark broadcasts
    projects when they are small and splits a hot project when they are not."""
    joined = photos.join(projects.select("project_id", "defaults"), "project_id")
    return (joined.withColumn("effective", effective(F.col("defaults"), F.col("overrides")))
            .withColumn("rendered", bypass(F.col("effective"), F.col("disabled"))).drop("defaults"))


def value(settings: Column, key: str) -> Column:
    field = "flag" if key in FLAGS else "text" if key in TEXTS else "num"
    return F.element_at(settings, key)[field]


def wide(settings: Column, keys: list[str] = KEYS) -> list[Column]:
    return [value(settings, k).alias(k) for k in keys]


def bypassed_columns(photos: DataFrame, projects: DataFrame, overrides: Column | None = None) -> DataFrame:
    """Photos with a column per setting as rendered: `with_effective` and `wide` without a map built for any photo.

    Without `overrides` the projects' defaults count alone.
    """
    stage_of = {k: stage for stage, keys in STAGES.items() for k in keys}
    base = projects.select("project_id", *[value(F.col("defaults"), k).alias(f"_{k}") for k in KEYS])

    def rendered(k: str) -> Column:
        own = F.col(f"_{k}")
        if overrides is not None:
            own = F.when(F.map_contains_key(overrides, k), value(overrides, k)).otherwise(own)
        return F.when(F.array_contains("disabled", stage_of[k]), value(F.create_map(F.lit(k), setting(k, IDENTITY.get(k, 0.0))), k)).otherwise(own)
    return photos.join(base, "project_id").select("photo_id", *[rendered(k).alias(k) for k in KEYS])


def inert(settings: Column, key: str) -> Column:
    """A key that cannot matter given the others of its stage."""
    if key == "lut_strength":
        return value(settings, "lut_path").isNull()
    if key == "grain_size":
        return F.coalesce(value(settings, "grain_amount") <= 0, F.lit(True))
    if key == "lens_correction_strength":
        return ~F.coalesce(value(settings, "lens_correction"), F.lit(False))
    return F.lit(False)


def adjusted(settings: Column, stage: str) -> Column:
    """True when a key of the stage that matters differs from doing nothing."""
    test = F.lit(False)
    for key in STAGES[stage]:
        same = value(settings, key).eqNullSafe(F.lit(IDENTITY.get(key, 0.0)))
        test = test | (~inert(settings, key) & ~same)
    return test


def grade(settings: Column, stages: list[str]) -> Column:
    keys = [k for s in stages for k in STAGES[s]]
    return F.map_filter(settings, lambda k, _: k.isin(keys))


def paste_grade(photos: DataFrame, grades: DataFrame, on: str = "photo_id", selected: Column | None = None) -> DataFrame:
    """Merge `grade` into each selected photo and replace its bypass list when one is given.

    `grades` holds (photo_id, grade, grade_disabled), or one row per `on`, say a project, for the photos that are
    `selected`; photos without a row stay as they are.
    """
    chosen = F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))
    joined = photos.join(grades, on, "left")
    return (joined.withColumn("overrides", F.when(chosen & F.col("grade").isNotNull(), overlay(F.col("overrides"), F.col("grade"))).otherwise(F.col("overrides")))
            .withColumn("disabled", F.when(chosen, F.coalesce("grade_disabled", "disabled")).otherwise(F.col("disabled"))).drop("grade", "grade_disabled"))


def apply_preset(photos: DataFrame, presets: DataFrame, name: str, selected: Column) -> DataFrame:
    """Apply a project's preset, named without regard to case, to the selected photos; adds `changed`.

    A flat preset replaces overrides and bypasses and clears the recipe; a preset with a recipe
    replaces the recipe and clears the others. The first preset of that name wins.
    """
    named = presets.where(F.lower("name") == name.lower()).groupBy("project_id").agg(
        F.min_by(F.struct("settings", F.col("disabled").alias("off"), F.col("recipe").alias("nodes"),
                          F.col("recipe_output").alias("out")), "seq").alias("p"))
    joined = photos.join(named, "project_id", "left").withColumn(
        "changed", F.col("p").isNotNull() & F.coalesce(selected, F.lit(False)))
    by_recipe, flat = F.col("changed") & F.col("p.nodes").isNotNull(), F.col("changed") & F.col("p.nodes").isNull()
    none = F.expr("cast(array() as array<string>)")
    return (joined
            .withColumn("overrides", F.when(flat, F.col("p.settings")).when(by_recipe, empty()).otherwise(F.col("overrides")))
            .withColumn("disabled", F.when(flat, F.col("p.off")).when(by_recipe, none).otherwise(F.col("disabled")))
            .withColumn("recipe", F.when(F.col("changed"), F.col("p.nodes")).otherwise(F.col("recipe")))
            .withColumn("recipe_output", F.when(F.col("changed"), F.col("p.out")).otherwise(F.col("recipe_output")))
            .drop("p"))


def reset(photos: DataFrame, selected: Column) -> DataFrame:
    return photos.withColumns({
        "overrides": F.when(selected, empty()).otherwise(F.col("overrides")),
        "disabled": F.when(selected, F.expr("cast(array() as array<string>)")).otherwise(F.col("disabled")),
        "recipe": F.when(selected, F.lit(None)).otherwise(F.col("recipe")),
        "recipe_output": F.when(selected, F.lit(None)).otherwise(F.col("recipe_output"))})


def toggle_stage(photos: DataFrame, stage: str, selected: Column) -> DataFrame:
    """Switch a stage on or off across each project's selection; its first photo sets the direction."""
    lead = photos.where(selected).groupBy("project_id").agg(
        F.min_by(F.array_contains("disabled", stage), "seq").alias("_enable"))
    joined = photos.join(lead, "project_id", "left")
    off = F.when(F.array_contains("disabled", stage), F.col("disabled")).otherwise(
        F.array_append("disabled", F.lit(stage)))
    return joined.withColumn("disabled", F.when(~selected, F.col("disabled")).when(
        F.col("_enable"), F.array_remove("disabled", stage)).otherwise(off)).drop("_enable")


def _stage_node(settings: Column, disabled: Column, stage: str) -> Column:
    params = []
    for key in STAGES[stage]:
        if key in TEXTS:
            continue
        v = value(settings, key)
        params.append(F.struct(F.lit(key).alias("k"), (v.cast("double") if key in FLAGS else v).alias("v")))
    bag = F.map_from_entries(F.filter(F.array(*params), lambda e: e["v"].isNotNull()))
    off = F.array_contains(disabled, stage)
    node = F.struct(F.lit(0).alias("id"), F.lit(stage).alias("kind"), bag.alias("params"),
                    F.expr("cast(map() as map<string,array<double>>)").alias("points"),
                    (value(settings, "lut_path") if stage == "film" else F.lit(None).cast("string")).alias("lut"),
                    F.lit(1.0).alias("opacity"), F.array(F.lit(0)).alias("inputs"), off.alias("bypassed"),
                    F.lit(None).alias("kind_states")).cast(NODE)
    return F.when(adjusted(settings, stage) | off, node)


def to_recipe(settings: Column, disabled: Column) -> Column:
    """The stages that do something, or are switched off, chained in execution order."""
    nodes = F.filter(F.array(*[_stage_node(settings, disabled, s) for s in EXECUTION_ORDER]), lambda n: n.isNotNull())
    return F.transform(nodes, lambda n, i: n.withField("id", i + 1).withField("inputs", F.array(i))).cast(RECIPE)


def default_recipe() -> Column:
    """Lens corrections, then noise reduction at 0.35."""
    start = {"lens_correction": True, "chromatic_aberration_correction": True, "noise_reduction": 0.35}
    return to_recipe(_constant({**IDENTITY, **start}), F.expr("cast(array() as array<string>)"))


def active_luts(recipe: Column, settings: Column | None = None) -> Column:
    """LUT paths a recipe really reads: film nodes switched on with a strength above 0 (1 if unset)."""
    film = F.filter(recipe, lambda n: (n["kind"] == "film") & ~n["bypassed"] & n["lut"].isNotNull() & (
        F.coalesce(F.element_at(n["params"], F.lit("lut_strength")), F.lit(1.0)) > 0))
    paths = F.array_distinct(F.transform(film, lambda n: n["lut"]))
    if settings is None:
        return paths
    return F.coalesce(paths, flat_luts(value(settings, "lut_path"), value(settings, "lut_strength")))


def flat_luts(path: Column, strength: Column) -> Column:
    return F.when(path.isNotNull() & (strength > 0), F.array(path)).otherwise(F.expr("cast(array() as array<string>)"))


def render_key(settings: Column | None, luts: Column, shape: Column) -> Column:
    """Digest of everything a render depends on: settings (columns of their names, if no map is given), LUT identities, output shape."""
    of = lambda k: F.col(k) if settings is None else value(settings, k)
    parts = [F.concat(F.lit(k + "="), F.coalesce(of(k).cast("string"), F.lit("-"))) for k in KEYS]
    return F.sha2(F.concat_ws(";", shape, *parts, F.array_join(luts, ",")), 256)


def node_keys(effective: Column, contents: Column) -> Column:
    """Map of node id to digest over the effective nodes of a recipe (struct of nodes and output).

    A node's digest covers its kind, opacity, parameters, curve points, the content of its LUT (from a map of path to content
    digest; a LUT that cannot be read is told apart from every content) and the digests of its inputs. So it stands for the
    pixels at that node: recipes that begin alike share digests as far as they are alike, whatever their node ids.
    """
    pairs = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")

    def digest(keys: Column, n: Column) -> Column:
        lut = F.when(n["lut"].isNotNull(), F.coalesce(F.element_at(contents, n["lut"]), F.concat(F.lit("unreadable "), n["lut"]))).otherwise(F.lit(""))
        inputs = F.transform(n["inputs"], lambda i: F.element_at(keys, i))
        return F.sha2(F.concat_ws("/", n["kind"], n["opacity"].cast("string"), pairs(n["params"]), pairs(n["points"]), lut,
                                  F.array_join(inputs, "+")), 256)
    start = F.create_map(F.lit(R.SOURCE), F.lit("source"))
    return F.aggregate(effective["nodes"], start, lambda keys, n: F.map_concat(keys, F.create_map(n["id"], digest(keys, n))))


def graph_render_key(effective: Column, contents: Column, shape: Column) -> Column:
    """Digest of a render by recipe: the output node's digest and the output shape."""
    return F.sha2(F.concat_ws(";", shape, F.element_at(node_keys(effective, contents), effective["output"])), 256)


def range_violations(rows: DataFrame, settings: str, key: str = "photo_id") -> DataFrame:
    """(key, setting, value) of each present setting outside its accepted range."""
    bad = F.lit(False)
    for name, (lo, hi) in RANGES.items():
        bad = bad | ((F.col("setting") == name) & ~F.col("v.num").between(lo, hi))
    bad = bad | ((F.col("setting") == "white_balance_temperature") & (F.col("v.num") <= 0))
    needs_number = F.col("setting").isin([k for k in KEYS if k not in FLAGS | TEXTS and k != "white_balance_temperature"])
    bad = F.coalesce(bad, F.lit(False)) | (needs_number & F.col("v.num").isNull()) | ~F.col("setting").isin(KEYS)
    return (rows.select(key, F.explode(settings).alias("setting", "v")).where(bad)
            .select(key, "setting", F.col("v.num").alias("value")))


def render_violations(rows: DataFrame, key: str = "photo_id") -> DataFrame:
    """Settings a renderer refuses, checked over the columns of `bypassed_columns`."""
    def bad(name: str) -> Column:
        v, (lo, hi) = F.col(name), RENDER_RANGES[name]
        outside = ~v.between(lo, hi)
        if name == "white_balance_temperature":
            outside = outside & (v != 0)
        return F.coalesce(outside | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
    found = [F.when(bad(k), F.struct(F.lit(k).alias("setting"), F.col(k).alias("value"))) for k in RENDER_RANGES]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.setting", "v.value")


# What a renderer accepts beside the stages' settings; the defaults are 92, 1 and 0 (no crop factor given).
OPTION_RANGES = {"quality": (1.0, 100.0), "focal_reducer": (0.1, 2.0), "crop_factor": (0.0, 10.0)}


def option_problems(options: Column) -> Column:
    """Output and lens options a renderer refuses, in a fixed order; missing numbers keep their defaults, so pass."""
    checks = [(~F.coalesce(options["format"].isin("jpeg", "tiff"), F.lit(False)), "format")]
    checks += [(F.coalesce(~options[k].between(lo, hi) | F.isnan(options[k].cast("double")), F.lit(False)), k)
               for k, (lo, hi) in OPTION_RANGES.items()]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def stage_list_ok(disabled: Column) -> Column:
    known = F.array(*[F.lit(s) for s in STAGES])
    return (F.size(F.array_distinct(disabled)) == F.size(disabled)) & (F.size(F.array_except(disabled, known)) == 0)


def export_problems(export: Column) -> Column:
    """What is wrong with export settings, in a fixed order; an empty list when nothing is."""
    def bad_bound(c: Column) -> Column:
        return F.coalesce(c <= 0, F.lit(False))
    checks = [(~F.coalesce(export["format"].isin("jpeg", "tiff"), F.lit(False)), "format"),
              (~F.coalesce(export["quality"].between(1, 100), F.lit(False)), "quality"),
              (bad_bound(export["max_width"]), "max_width"), (bad_bound(export["max_height"]), "max_height")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def repeated_names(presets: DataFrame) -> DataFrame:
    """Preset names used twice in a project, case aside, and blank names."""
    named = presets.groupBy("project_id", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    return named.where((F.col("uses") > 1) | (F.btrim(F.coalesce("name", F.lit(""))) == ""))
