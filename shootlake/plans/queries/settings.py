"""Registered queries: settings, grades, presets and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.functions.settings_keys import EXECUTION_ORDER, FLAGS, IDENTITY, KEYS, RANGES, RENDER_RANGES, STAGES, TEXTS
from shootlake.operators import settings as S
from shootlake.plans import fixtures as fx
from shootlake.plans.registry import query

_STAGE = {k: s for s, ks in STAGES.items() for k in ks}


def _lit(v):
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{float(v)}::DOUBLE"


def _same(k):
    return _lit(IDENTITY.get(k, 0.0))


_RENDERED = "SELECT photo_id, project_id, disabled, " + ", ".join(
    f"CASE WHEN list_contains(disabled, '{_STAGE[k]}') THEN {_same(k)} ELSE {k} END AS {k}" for k in KEYS) + " FROM effective"
_INERT = {"lut_strength": "lut_path IS NULL", "grain_size": "grain_amount <= 0", "lens_correction_strength": "NOT lens_correction"}


def _active(stage):
    return "(" + " OR ".join(f"({k} IS DISTINCT FROM {_same(k)}" + (f" AND NOT ({_INERT[k]})" if k in _INERT else "") + ")"
                             for k in STAGES[stage]) + ")"


def _photos(spark, sf):
    return S.with_effective(fx.photos(spark, sf), fx.projects(spark, sf))


def _rendered(spark, sf):
    return S.bypassed_columns(fx.photos(spark, sf), fx.projects(spark, sf), F.col("overrides"))


@query("settings_effective", fx.sql("SELECT photo_id, " + ", ".join(KEYS) + " FROM effective", "effective"))
def settings_effective(spark, sf):
    return _photos(spark, sf).select("photo_id", *S.wide(F.col("effective")))


@query("settings_as_rendered", fx.sql("SELECT photo_id, " + ", ".join(KEYS) + " FROM rendered", "effective", also={"rendered": _RENDERED}))
def settings_as_rendered(spark, sf):
    return _rendered(spark, sf)


@query("stage_bypass_defaults", fx.sql("SELECT photo_id, " + ", ".join(
    f"CASE WHEN list_contains(disabled, '{_STAGE[k]}') THEN {_same(k)} ELSE df_{k} END AS {k}" for k in KEYS)
    + " FROM photos JOIN projects USING (project_id)", "photos", "projects"))
def stage_bypass_defaults(spark, sf):
    return S.bypassed_columns(fx.photos(spark, sf), fx.projects(spark, sf))


@query("inert_keys", fx.sql("SELECT photo_id, " + ", ".join(f"{c} AS {k}" for k, c in _INERT.items()) + " FROM effective", "effective"))
def inert_keys(spark, sf):
    return _photos(spark, sf).select("photo_id", *[S.inert(F.col("effective"), k).alias(k) for k in _INERT])


@query("stage_adjusted", fx.sql("SELECT photo_id, " + ", ".join(f"{_active(s)} AS {s}" for s in STAGES) + " FROM effective", "effective"))
def stage_adjusted(spark, sf):
    return _photos(spark, sf).select("photo_id", *[S.adjusted(F.col("effective"), s).alias(s) for s in STAGES])


_GRADE_KEYS = STAGES["tone"] + STAGES["film"]


@query("grade_extract", fx.sql("SELECT photo_id, " + str(len(_GRADE_KEYS)) + "::BIGINT AS keys, " + ", ".join(_GRADE_KEYS) + " FROM effective", "effective"))
def grade_extract(spark, sf):
    g = _photos(spark, sf).withColumn("grade", S.grade(F.col("effective"), ["tone", "film"]))
    return g.select("photo_id", F.size("grade").cast("long").alias("keys"), *S.wide(F.col("grade"), _GRADE_KEYS))


_PASTED = ["exposure", "tone_shadows", "tone_blacks", "grain_amount", "lut_path"]


@query("grade_paste", fx.sql(f"""
  SELECT p.photo_id, {", ".join(
      f"CASE WHEN p.selected THEN l.{k} " + (f"WHEN p.has_{k} THEN p.ov_{k} END" if k in fx.OVERRIDES else "END") + f" AS {k}"
      for k in _PASTED if k != "exposure")},
      CASE WHEN p.has_exposure THEN p.ov_exposure END AS exposure,
      array_to_string(CASE WHEN p.selected THEN l.disabled ELSE p.disabled END, ',') AS disabled
  FROM photos p JOIN leads l USING (project_id)""", "photos", "effective", also={
      "leads": "SELECT * FROM effective WHERE photo_id IN (SELECT min(photo_id) FROM photos GROUP BY project_id)"}))
def grade_paste(spark, sf):
    photos = fx.photos(spark, sf)
    # the first photo's place is found from two numbers a photo; its settings alone are made
    first = fx.photos(spark, sf).groupBy("project_id").agg(F.min("seq").alias("seq"))
    leads = S.with_effective(fx.photos(spark, sf).join(first, ["project_id", "seq"]), fx.projects(spark, sf))
    grades = leads.select("project_id", S.grade(F.col("effective"), ["tone", "film"]).alias("grade"), F.col("disabled").alias("grade_disabled"))
    out = S.paste_grade(photos, grades, "project_id", F.col("selected"))
    return out.select("photo_id", *S.wide(F.col("overrides"), _PASTED), F.array_join("disabled", ",").alias("disabled"))


@query("preset_apply", fx.sql("""
  SELECT photo_id, s.name IS NOT NULL AND selected AS changed,
         CASE WHEN s.name IS NOT NULL AND selected THEN CASE WHEN NOT by_recipe THEN s.exposure END
              WHEN has_exposure THEN ov_exposure END AS exposure,
         CASE WHEN s.name IS NOT NULL AND selected THEN CASE WHEN NOT by_recipe THEN s.lut_path END
              WHEN has_lut_path THEN ov_lut_path END AS lut_path,
         CASE WHEN s.name IS NOT NULL AND selected THEN CASE WHEN NOT by_recipe AND tone_off THEN 'tone' ELSE '' END
              ELSE array_to_string(disabled, ',') END AS disabled,
         CASE WHEN s.name IS NOT NULL AND selected AND by_recipe THEN 2 ELSE 0 END AS nodes
  FROM photos LEFT JOIN (SELECT * FROM presets WHERE lower(name) = 'red widget'
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seq) = 1) s USING (project_id)""", "photos", "presets"))
def preset_apply(spark, sf):
    out = S.apply_preset(fx.photos(spark, sf), fx.presets(spark, sf), "Red Widget", F.col("selected"))
    return out.select("photo_id", "changed", *S.wide(F.col("overrides"), ["exposure", "lut_path"]),
                      F.array_join("disabled", ",").alias("disabled"),
                      F.coalesce(F.size("recipe"), F.lit(0)).alias("nodes"))


@query("reset_edits", fx.sql("""
  SELECT photo_id, CASE WHEN selected THEN 0 ELSE """ + " + ".join(f"has_{k}::INT" for k in fx.OVERRIDES) + """ END AS overrides,
         CASE WHEN selected THEN 0 ELSE len(disabled) END AS disabled FROM photos""", "photos"))
def reset_edits(spark, sf):
    return S.reset(fx.photos(spark, sf), F.col("selected")).select(
        "photo_id", F.size("overrides").alias("overrides"), F.size("disabled").alias("disabled"))


@query("toggle_stage", fx.sql("""
  SELECT photo_id, array_to_string(CASE WHEN NOT selected THEN disabled
      WHEN lead THEN list_filter(disabled, lambda s: s <> 'tone')
      WHEN list_contains(disabled, 'tone') THEN disabled ELSE list_append(disabled, 'tone') END, ',') AS disabled
  FROM photos LEFT JOIN (SELECT project_id, arg_min(list_contains(disabled, 'tone'), seq) AS lead
                         FROM photos WHERE selected GROUP BY 1) USING (project_id)""", "photos"))
def toggle_stage(spark, sf):
    return S.toggle_stage(fx.photos(spark, sf), "tone", F.col("selected")).select(
        "photo_id", F.array_join("disabled", ",").alias("disabled"))


_CHAIN = "list_filter([" + ", ".join(
    f"CASE WHEN list_contains(disabled, '{s}') THEN '{s}*' WHEN {_active(s)} THEN '{s}' END" for s in EXECUTION_ORDER) + "], lambda s: s IS NOT NULL)"


@query("settings_to_recipe", fx.sql(f"""
  SELECT photo_id, array_to_string(chain, '>') AS chain, len(chain) AS output,
         len(list_filter(chain, lambda s: NOT ends_with(s, '*'))) AS effective_nodes
  FROM (SELECT photo_id, {_CHAIN} AS chain FROM effective)""", "effective"))
def settings_to_recipe(spark, sf):
    r = _photos(spark, sf).withColumn("nodes", S.to_recipe(F.col("effective"), F.col("disabled")))
    return r.select(
        "photo_id", F.array_join(F.transform("nodes", lambda n: F.concat(n["kind"], F.when(n["bypassed"], "*").otherwise(""))), ">").alias("chain"),
        F.coalesce(F.element_at(F.transform("nodes", lambda n: n["id"]), F.nullif(F.size("nodes"), F.lit(0))), F.lit(0)).cast("long").alias("output"),
        F.size(F.filter("nodes", lambda n: ~n["bypassed"])).cast("long").alias("effective_nodes"))


@query("default_recipes", fx.sql("""
  SELECT photo_id, 'optics(0),noise_reduction(1)' AS chain, 0.35::DOUBLE AS noise_reduction FROM photos""", "photos"))
def default_recipes(spark, sf):
    fresh = fx.photos(spark, sf).withColumn("nodes", S.default_recipe())
    return fresh.select("photo_id", F.array_join(F.transform("nodes", lambda n: F.concat(n["kind"], F.lit("("), n["inputs"][0], F.lit(")"))), ",").alias("chain"),
                        F.expr("nodes[1].params['noise_reduction']").alias("noise_reduction"))


@query("active_luts", fx.sql("""
  SELECT lut_path AS path, count(*) AS photos FROM effective
  WHERE lut_path IS NOT NULL AND lut_strength > 0 AND NOT list_contains(disabled, 'film') GROUP BY 1""", "effective"))
def active_luts(spark, sf):
    r = _photos(spark, sf).withColumn("nodes", S.to_recipe(F.col("effective"), F.col("disabled")))
    return r.select(F.explode(S.active_luts(F.col("nodes"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("photos"))


def _text(k):
    return f"'{k}=' || coalesce(CAST({k} AS VARCHAR), '-')" if k in FLAGS | TEXTS else f"'{k}=' || coalesce(CAST(CAST({k} AS DOUBLE) AS VARCHAR), '-')"


@query("render_keys", fx.sql(f"""
  SELECT photo_id, sha256(concat_ws(';', '2048x2048q88', {", ".join(_text(k) for k in KEYS)},
         CASE WHEN lut_path IS NOT NULL AND lut_strength > 0 THEN lut_path ELSE '' END)) AS render_key
  FROM rendered""", "effective", also={"rendered": _RENDERED}))
def render_keys(spark, sf):
    luts = S.flat_luts(F.col("lut_path"), F.col("lut_strength"))
    return _rendered(spark, sf).select("photo_id", S.render_key(None, luts, F.lit("2048x2048q88")).alias("render_key"))


def _range_case(k, v):
    lo, hi = RANGES[k]
    return f"NOT ({v} BETWEEN {lo} AND {hi})"


@query("settings_violations", fx.sql(" UNION ALL ".join(
    f"SELECT photo_id, '{k}' AS setting, CAST(ov_{k} AS DOUBLE) AS value FROM photos WHERE has_{k} AND " + (
        f"ov_{k} <= 0" if k == "white_balance_temperature" else _range_case(k, f"ov_{k}"))
    for k in fx.OVERRIDES if k in RANGES or k == "white_balance_temperature"), "photos"))
def settings_violations(spark, sf):
    return S.range_violations(fx.photos(spark, sf), "overrides")


@query("render_violations", fx.sql(" UNION ALL ".join(
    f"SELECT photo_id, '{k}' AS setting, CAST({k} AS DOUBLE) AS value FROM rendered WHERE NOT ({k} BETWEEN {lo} AND {hi})"
    + (f" AND {k} <> 0" if k == "white_balance_temperature" else "") for k, (lo, hi) in RENDER_RANGES.items()),
    "effective", also={"rendered": _RENDERED}))
def render_violations(spark, sf):
    return S.render_violations(_rendered(spark, sf))


@query("repeated_preset_names", fx.sql("""
  SELECT project_id, lower(name) AS name, count(*) AS uses FROM presets WHERE origin = 'project'
  GROUP BY 1, 2 HAVING count(*) > 1""", "presets"))
def repeated_preset_names(spark, sf):
    return S.repeated_names(fx.presets(spark, sf).where("origin = 'project'"))


@query("disabled_stage_check", fx.sql("""
  SELECT photo_id, o_orderpriority <> '5-LOW' AND o_orderpriority <> '1-URGENT' AS ok
  FROM photos JOIN orders ON o_orderkey = photo_id""", "photos"))
def disabled_stage_check(spark, sf):
    """The bypass lists with the given priority names mixed in: one repeats a stage, one is unknown."""
    stages = F.when(F.array_contains("disabled", "noise_reduction"), F.array_append("disabled", F.lit("noise_reduction"))).when(
        F.size("disabled") == 0, F.array(F.lit("blend"))).otherwise(F.col("disabled"))
    return fx.photos(spark, sf).select("photo_id", S.stage_list_ok(stages).alias("ok"))


@query("export_problems", fx.sql("""
  SELECT project_id, concat_ws(',', CASE WHEN format NOT IN ('jpeg', 'tiff') THEN 'format' END,
         CASE WHEN quality NOT BETWEEN 1 AND 100 THEN 'quality' END, CASE WHEN max_width <= 0 THEN 'max_width' END) AS problems
  FROM projects""", "projects"))
def export_problems(spark, sf):
    return fx.projects(spark, sf).select("project_id", F.array_join(S.export_problems(F.col("export")), ",").alias("problems"))


@query("render_options", """
  SELECT l_orderkey AS photo_id, l_linenumber AS attempt, array_to_string(list_filter([
      CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'format' END, CASE WHEN q NOT BETWEEN 1 AND 100 THEN 'quality' END,
      CASE WHEN a = 12 OR CAST(a AS DOUBLE) / 5 NOT BETWEEN CAST(0.1 AS DOUBLE) AND 2 THEN 'focal_reducer' END,
      CASE WHEN b = 0 OR b = 10 THEN 'crop_factor' END], lambda w: w IS NOT NULL), ' ') AS problems
  FROM (SELECT *, CAST(l_quantity AS INTEGER) * 3 - 20 AS q, CASE WHEN l_partkey % 13 = 11 THEN NULL ELSE l_partkey % 13 END AS a,
               l_suppkey % 11 AS b FROM lineitem)""")
def render_options(spark, sf):
    made = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS photo_id", "l_linenumber AS attempt", """named_struct(
        'format', CASE l_returnflag WHEN 'A' THEN 'jpeg' WHEN 'N' THEN 'tiff' ELSE lower(l_returnflag) END, 'quality', int(l_quantity) * 3 - 20,
        'focal_reducer', CASE l_partkey % 13 WHEN 12 THEN double('NaN') WHEN 11 THEN NULL ELSE double(l_partkey % 13) / 5 END,
        'crop_factor', if(l_suppkey % 11 = 10, double('Infinity'), double(l_suppkey % 11) - 1)) AS options""")
    return made.select("photo_id", "attempt", F.array_join(S.option_problems(F.col("options")), " ").alias("problems"))
