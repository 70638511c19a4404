"""Registered queries: lenses, names, stills, interned files, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shootlake.functions import text as T
from shootlake.operators import catalogue as C
from shootlake.operators import lenses as LE
from shootlake.operators import store as ST
from shootlake.plans import fixtures as fx
from shootlake.plans.queries.catalogue import _ALSO, _DIGITS, _USABLE
from shootlake.plans.registry import query

# Lens and camera rows from the parts; names carry punctuation and case to be normalised away.
_LENSES = "SELECT p_partkey AS seq, concat(p_name, ' / ', p_brand) AS model, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS mount, CAST(p_size AS DOUBLE) AS focal_min, CAST(p_size * 2 AS DOUBLE) AS focal_max FROM part"
_CAMERAS = "SELECT p_partkey AS seq, concat('Maker ', p_brand) AS maker, concat(p_name, ' ', CAST(p_size AS {s})) AS model, p_type AS mount, 1 + p_size % 10 / 10 AS crop_factor FROM part"
# What photos say about themselves.
_SHOTS = """SELECT o_orderkey AS photo_id, concat('MAKER-Brand#', CAST(o_custkey % 25 + 1 AS {s})) AS make,
    CAST(5 + o_orderkey % 60 AS DOUBLE) AS focal, o_custkey % 2000 AS part_at FROM orders"""
_ASKED = """SELECT photo_id, make, focal, concat(p_name, '-', CAST(p_size AS {s}), ' II') AS model, CASE WHEN photo_id % 3 = 0 THEN p_name WHEN photo_id % 3 = 1 THEN concat(upper(p_name), '_', p_brand) ELSE concat('my ', p_name, ' ', p_brand, ' lens') END AS lens_name, p_type AS camera_mount
    FROM shots LEFT JOIN part ON p_partkey = part_at"""
_MOUNTS = "SELECT DISTINCT p_type AS mount, 'SMALL' AS compatible FROM part WHERE p_type IN ('ECONOMY', 'LARGE')"
_NORM = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_LENS_SQL = {"lenses": _LENSES, "cameras": _CAMERAS.format(s="varchar"), "shots": _SHOTS.format(s="varchar"), "asked": _ASKED.format(s="varchar"), "mounts": _MOUNTS}


def lens_tables(spark, sf):
    for t in ("part", "orders"):
        fx.table(spark, sf, t).createOrReplaceTempView(t)
    made = {}
    for name, text in (("lenses", _LENSES), ("cameras", _CAMERAS), ("shots", _SHOTS), ("asked", _ASKED), ("mounts", _MOUNTS)):
        made[name] = spark.sql(text.replace("{s}", "string"))
        made[name].createOrReplaceTempView(name)
    return made


def _match(asked, name):
    return f"({name} = {asked} OR (length({name}) >= 5 AND (contains({name}, {asked}) OR contains({asked}, {name}))))"


@query("camera_match", fx.sql(f"""
  SELECT photo_id, b.seq AS camera, b.mount AS camera_mount, round(b.crop_factor, 6) AS camera_crop FROM (SELECT *, {_NORM.format('make')} AS mk, {_NORM.format('model')} AS md FROM asked) a LEFT JOIN (
    SELECT q.mk, q.md, arg_min(c.seq, c.seq) AS seq, arg_min(c.mount, c.seq) AS mount, arg_min(c.crop_factor, c.seq) AS crop_factor
    FROM (SELECT DISTINCT {_NORM.format('make')} AS mk, {_NORM.format('model')} AS md FROM asked) q JOIN (SELECT *, {_NORM.format('maker')} AS nk, {_NORM.format('model')} AS nd FROM cameras) c
    ON {_match('q.mk', 'c.nk')} AND {_match('q.md', 'c.nd')} GROUP BY 1, 2) b ON a.mk IS NOT DISTINCT FROM b.mk AND a.md IS NOT DISTINCT FROM b.md""", also=_LENS_SQL))
def camera_match(spark, sf):
    t = lens_tables(spark, sf)
    m = LE.match_camera(t["asked"].drop("camera_mount"), t["cameras"])
    return m.select("photo_id", "camera", "camera_mount", F.round("camera_crop", 6).alias("camera_crop"))


@query("lens_match", fx.sql(f"""
  SELECT a.photo_id, b.seq AS lens, b.score AS lens_score FROM (SELECT *, {_NORM.format('lens_name')} AS ln FROM asked) a LEFT JOIN (
    SELECT ln, focal, camera_mount, seq, score FROM (
      SELECT q.*, l.seq, length(l.nn) + CASE WHEN l.nn = q.ln THEN 2 ELSE 0 END AS score, row_number() OVER (PARTITION BY q.ln, q.focal, q.camera_mount ORDER BY length(l.nn) + CASE WHEN l.nn = q.ln THEN 2 ELSE 0 END DESC, l.seq DESC) AS k
      FROM (SELECT DISTINCT {_NORM.format('lens_name')} AS ln, focal, camera_mount FROM asked) q JOIN (SELECT *, {_NORM.format('model')} AS nn FROM lenses) l
      ON (l.mount = '' OR l.mount = q.camera_mount OR (l.mount = 'SMALL' AND q.camera_mount IN ('ECONOMY', 'LARGE'))) AND (l.focal_min <= 0 OR q.focal >= l.focal_min - 0.1) AND (l.focal_max <= 0 OR q.focal <= l.focal_max + 0.1)
         AND {_match('q.ln', 'l.nn')}) WHERE k = 1) b ON a.ln = b.ln AND a.focal = b.focal AND a.camera_mount = b.camera_mount""", also=_LENS_SQL))
def lens_match(spark, sf):
    t = lens_tables(spark, sf)
    m = LE.match_lens(t["asked"], t["lenses"], t["mounts"])
    return m.select("photo_id", F.col("lens"), F.col("lens_score").cast("long").alias("lens_score"))


@query("mount_compatible_lenses", fx.sql("""
  SELECT DISTINCT lower(m.mount) AS camera_mount, seq FROM lenses l JOIN (
    SELECT mount, compatible FROM mounts UNION SELECT mount, mount FROM mounts) m ON lower(l.mount) = lower(m.compatible)""", also=_LENS_SQL))
def mount_compatible_lenses(spark, sf):
    t = lens_tables(spark, sf)
    return t["lenses"].withColumn("lens_mount", F.lower("mount")).join(LE.compatible_mounts(t["mounts"]), "lens_mount").select("camera_mount", "seq")


# Aliases the users keep: every part name is a nickname; the first listed wins, ahead of the built-in ones.
_ALIASES = "SELECT p_name AS nickname, concat(p_name, ' / ', p_brand) AS model, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 0.5 + p_partkey % 10 / 10 END AS focal_reducer, p_partkey % 3 / 1 AS crop_factor, p_partkey AS seq FROM part"
_RESOLVED = f"""SELECT photo_id, focal, model AS alias_model, CASE WHEN model IS NOT NULL THEN coalesce(focal_reducer, 1) END AS focal_reducer, crop_factor AS alias_crop
  FROM (SELECT photo_id, focal, CASE WHEN photo_id % 3 = 0 THEN upper(lens_name) WHEN photo_id % 30 = 1 THEN 'ZEISS planar 0.7X' ELSE lens_name END AS nick FROM asked) LEFT JOIN (
    SELECT lower(nickname) AS n, model, focal_reducer, crop_factor FROM ({_ALIASES}) QUALIFY row_number() OVER (PARTITION BY lower(nickname) ORDER BY seq) = 1
    UNION ALL SELECT 'zeiss planar 0.7x', 'Carl Zeiss Makro-Planar T* 2/50 ZF.2', 0.71, 2.0) ON n = lower(nick)"""
_ALIAS_SQL = {**_LENS_SQL, "resolved": _RESOLVED}


def _resolved(spark, sf):
    t = lens_tables(spark, sf)
    user = spark.sql(_ALIASES).withColumns({"focal_reducer": F.col("focal_reducer").cast("double"), "crop_factor": F.col("crop_factor").cast("double")})
    nick = F.expr("CASE WHEN photo_id % 3 = 0 THEN upper(lens_name) WHEN photo_id % 30 = 1 THEN 'ZEISS planar 0.7X' ELSE lens_name END")
    photos = t["asked"].select("photo_id", "focal", nick.alias("lens_description"))
    return t, LE.resolve_alias(photos, LE.with_built_in(user))


@query("lens_aliases", fx.sql("SELECT photo_id, alias_model, round(CAST(focal_reducer AS DOUBLE), 6) AS focal_reducer, CAST(alias_crop AS DOUBLE) AS alias_crop FROM resolved", also=_ALIAS_SQL))
def lens_aliases(spark, sf):
    return _resolved(spark, sf)[1].select("photo_id", "alias_model", F.round("focal_reducer", 6).alias("focal_reducer"), "alias_crop")


@query("alias_problems", fx.sql(f"""
  SELECT seq, concat_ws(',', CASE WHEN NOT (coalesce(focal_reducer, 1) BETWEEN 0.1 AND 2) THEN 'reducer' END, CASE WHEN NOT (crop_factor BETWEEN 0.1 AND 10) THEN 'crop' END) AS problems FROM ({_ALIASES})"""))
def alias_problems(spark, sf):
    fx.table(spark, sf, "part").createOrReplaceTempView("part")
    a = spark.sql(_ALIASES)
    return a.select("seq", F.array_join(LE.alias_problems(F.col("nickname"), F.col("model"), F.col("focal_reducer"), F.col("crop_factor")), ",").alias("problems"))


@query("adapted_lenses", fx.sql(f"""
  SELECT photo_id, round(focal / coalesce(focal_reducer, 1), 6) AS profile_focal, round(crop * coalesce(focal_reducer, 1), 6) AS profile_crop, crop IS NOT NULL AS geometry_ok,
         (SELECT max(seq) FROM lenses l WHERE {_NORM.format('l.model')} = {_NORM.format('alias_model')} AND focal / coalesce(focal_reducer, 1) >= focal_min - 0.1 AND focal / coalesce(focal_reducer, 1) <= focal_max + 0.1) AS lens
  FROM (SELECT *, CASE WHEN alias_crop > 0 THEN alias_crop WHEN photo_id % 2 = 0 THEN 1.5 END AS crop FROM resolved)""", also=_ALIAS_SQL))
def adapted_lenses(spark, sf):
    t, photos = _resolved(spark, sf)
    known = photos.withColumn("camera_crop", F.expr("CASE WHEN photo_id % 2 = 0 THEN 1.5D END"))
    m = LE.match_explicit(LE.adapted_geometry(known), t["lenses"])
    return m.select("photo_id", F.round("profile_focal", 6).alias("profile_focal"), F.round("profile_crop", 6).alias("profile_crop"), "geometry_ok", "lens")


@query("lens_fallback", fx.sql(f"""
  SELECT photo_id, photo_id % 5 <> 0 AND lens IS NOT NULL AS optics, CASE WHEN photo_id % 5 <> 0 AND lens IS NULL THEN 'no lens profile' END AS warning FROM (
    SELECT photo_id, (SELECT max(seq) FROM lenses l WHERE {_NORM.format('l.model')} = {_NORM.format('alias_model')} AND focal / coalesce(focal_reducer, 1) >= focal_min - 0.1 AND focal / coalesce(focal_reducer, 1) <= focal_max + 0.1) AS lens FROM resolved)""", also=_ALIAS_SQL))
def lens_fallback(spark, sf):
    t, photos = _resolved(spark, sf)
    m = LE.match_explicit(LE.adapted_geometry(photos.withColumn("camera_crop", F.lit(1.5))), t["lenses"])
    return LE.fall_back(m, F.col("photo_id") % 5 != 0).select("photo_id", "optics", "warning")


@query("effective_lens_name", fx.sql("""
  SELECT photo_id, CASE WHEN photo_id % 4 = 0 THEN coalesce(lens_type, lens_id, '') ELSE coalesce(nullif(CASE WHEN photo_id % 4 = 1 THEN '' ELSE 'Own ' || photo_id END, ''), lens_type, lens_id, '') END AS lens_name FROM usable""",
    "exif_raw", also=_ALSO))
def effective_lens_name(spark, sf):
    own = F.expr("CASE photo_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Own ', photo_id) END")
    return C.records(fx.exif_raw(spark, sf)).select("photo_id", LE.effective_name(own, F.col("lens_name")).alias("lens_name"))


# Naming.
_NAMED = {"usable": _USABLE, "digits": _DIGITS,
          "naming": """SELECT p.*, output_dir, format, timestamp_names, CASE WHEN timestamp_names AND coalesce(d1, d2) IS NOT NULL AND p.photo_id % 4 <> 3 THEN '20240101-120000-' || stem ELSE stem END AS auto_stem
            FROM photos p JOIN projects USING (project_id) JOIN digits d ON d.photo_id = p.photo_id"""}


def _naming(spark, sf):
    """Photos with their project's naming rules; the timestamp is one instant, so that names repeat."""
    p = fx.projects(spark, sf).select("project_id", "output_dir", "export.format", "export.timestamp_names")
    known = C.records(fx.exif_raw(spark, sf)).select("photo_id", F.when(F.col("timestamp_token").isNotNull() & (F.col("photo_id") % 4 != 3), "20240101-120000").alias("timestamp_token"))
    return ST.automatic_stem(fx.photos(spark, sf).drop("overrides", "recipe").join(p, "project_id").join(known, "photo_id"))


@query("output_paths", fx.sql("""
  SELECT photo_id, CASE WHEN output LIKE '/%' THEN output WHEN output IS NOT NULL THEN output_dir || '/' || output ELSE output_dir || '/' || auto_stem || CASE WHEN format = 'tiff' THEN '.tif' ELSE '.jpg' END END AS path FROM naming""",
    "photos", "projects", "exif_raw", also=_NAMED))
def output_paths(spark, sf):
    return _naming(spark, sf).select("photo_id", ST.output_path(F.col("output"), F.col("auto_stem"), F.col("format"), F.col("output_dir")).alias("path"))


@query("collision_free_names")
def collision_free_names(spark, sf):
    """No SQL: each contested name depends on all before it; checked against brute force in the tests."""
    return ST.free_stems(_naming(spark, sf)).select("project_id", "photo_id", "auto_stem", "final_stem")


@query("add_unique_photos", fx.sql("""
  SELECT project_id, input, min(seq) AS seq FROM (SELECT (project_id + 1) % 20 AS project_id, input, seq FROM photos) b
  WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE p.project_id = b.project_id AND p.input = b.input) GROUP BY 1, 2""", "photos"))
def add_unique_photos(spark, sf):
    p = fx.photos(spark, sf).select("project_id", "seq", "input")
    return ST.add_unique(p, p.withColumn("project_id", (F.col("project_id") + 1) % 20))


@query("remove_selected", fx.sql("SELECT project_id, count(*) AS left_over FROM photos WHERE NOT selected GROUP BY 1", "photos"))
def remove_selected(spark, sf):
    p = fx.photos(spark, sf)
    return ST.remove(p, p.where("selected")).groupBy("project_id").agg(F.count(F.lit(1)).alias("left_over"))


# Some still numbers of every photo's stem are taken already.
@query("next_still_names", fx.sql("""
  SELECT project_id, photo_id, 'Still ' || lpad(CAST(min(i) AS VARCHAR), 3, '0') || ' (' || stem || ')' AS still FROM photos p, range(1, 6) c(i)
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.project_id = p.project_id AND t.name = lower('Still 00' || i || ' (' || stem || ')')) GROUP BY project_id, photo_id, stem""",
    "photos", also={"taken": "SELECT DISTINCT project_id, lower('STILL 00' || n || ' (' || stem || ')') AS name FROM photos, range(1, 5) r(n) WHERE (seq + n) % 3 = 0"}))
def next_still_names(spark, sf):
    p = fx.photos(spark, sf)
    taken = p.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("(seq + n) % 3 = 0").select(
        "project_id", F.concat(F.lit("STILL 00"), F.col("n").cast("string"), F.lit(" ("), T.stem(F.col("input")), F.lit(")")).alias("name"))
    return ST.next_still_name(p, taken)


@query("still_gallery", fx.sql("SELECT origin, seq, name, sha256(name) AS still_id, written FROM presets", "presets"))
def still_gallery(spark, sf):
    p = fx.presets(spark, sf).select("origin", "seq", "name", "written")
    g = ST.gallery(p.where("origin = 'project'").drop("origin"), p.where("origin = 'local'").drop("origin"))
    return g.orderBy("written", "seq")


_STORE = {"store": "SELECT name, max(written) AS written, max(seq) AS seq FROM presets WHERE origin = 'local' GROUP BY 1",
          "batch": "SELECT CASE WHEN seq % 5 = 0 THEN name || ' II' ELSE name END AS name, written, seq FROM presets WHERE origin = 'project'"}


def _store(spark, sf):
    p = fx.presets(spark, sf)
    store = p.where("origin = 'local'").groupBy("name").agg(F.max("written").alias("written"), F.max("seq").alias("seq"))
    batch = p.where("origin = 'project'").selectExpr("CASE WHEN seq % 5 = 0 THEN concat(name, ' II') ELSE name END AS name", "written", "seq")
    return store, batch


@query("still_upsert", fx.sql("""
  SELECT name, written, seq FROM batch QUALIFY row_number() OVER (PARTITION BY name ORDER BY written DESC, seq DESC) = 1
  UNION ALL SELECT name, written, seq FROM store WHERE name NOT IN (SELECT name FROM batch)""", "presets", also=_STORE))
def still_upsert(spark, sf):
    return ST.upsert_stills(*_store(spark, sf))


@query("still_refused", fx.sql("SELECT DISTINCT name FROM batch WHERE name IN (SELECT name FROM store)", "presets", also=_STORE))
def still_refused(spark, sf):
    return ST.refused_stills(*_store(spark, sf))


@query("still_rename", fx.sql("""
  SELECT CASE WHEN seq % 2 = 0 THEN name || ' 2' ELSE name END AS name, written, seq FROM store""", "presets", also=_STORE))
def still_rename(spark, sf):
    store, _ = _store(spark, sf)
    return ST.rename_stills(store, store.where("seq % 2 = 0").select("name", F.concat("name", F.lit(" 2")).alias("new_name")))


@query("still_delete", fx.sql("SELECT name, written, seq FROM store WHERE name NOT IN (SELECT name FROM batch)", "presets", also=_STORE))
def still_delete(spark, sf):
    store, batch = _store(spark, sf)
    return ST.delete_stills(store, batch)


_KEYED = {"keyed": "SELECT path, sha256(text) AS content_key FROM files", "placed": "SELECT path, '/store/' || substr(content_key, 1, 12) || '-' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.raw$', '') || '.raw' AS target FROM keyed"}


@query("intern_plan", fx.sql("""
  SELECT path, target, path = first AND target NOT IN (SELECT target FROM placed WHERE length(path) % 2 = 0) AS copy FROM (SELECT *, min(path) OVER (PARTITION BY target) AS first FROM placed)""", "files", also=_KEYED))
def intern_plan(spark, sf):
    keyed = fx.files(spark, sf).select("path", C.content_key(F.col("text")).alias("content_key"))
    present = keyed.where("length(path) % 2 = 0").select(ST.interned_path(F.col("path"), F.col("content_key"), "/store").alias("path"))
    return ST.intern_plan(keyed, present, "/store")


@query("resolved_paths", fx.sql("""
  SELECT photo_id, CASE WHEN input LIKE '/%' THEN input ELSE '/shoots/' || input END AS input,
         CASE WHEN has_lut_path THEN CASE WHEN ov_lut_path LIKE '/%' THEN ov_lut_path ELSE '/shoots/' || ov_lut_path END END AS lut FROM photos""", "photos"))
def resolved_paths(spark, sf):
    r = ST.resolve_paths(fx.photos(spark, sf), "/shoots")
    return r.select("photo_id", "input", F.expr("overrides['lut_path'].text").alias("lut"))


_CAUSES = {"causes": """SELECT project_id, seq, CASE WHEN has_tone_shadows AND NOT ov_tone_shadows BETWEEN -2 AND 2 THEN 'setting' WHEN format NOT IN ('jpeg', 'tiff') THEN 'format' WHEN seq % 400 = 17 THEN 'input' END AS cause
  FROM photos JOIN projects USING (project_id)"""}


def _causes(spark, sf):
    joined = fx.photos(spark, sf).join(fx.projects(spark, sf).select("project_id", "export"), "project_id")
    return joined.select("project_id", "seq", F.when(~F.coalesce(F.expr("overrides['tone_shadows'].num").between(-2, 2), F.lit(True)), "setting").when(
        ~F.col("export.format").isin("jpeg", "tiff"), "format").when(F.col("seq") % 400 == 17, "input").alias("cause"))


@query("render_report", fx.sql("""
  SELECT project_id, count(*) FILTER (cause IS NULL) AS completed, count(cause) AS failed, arg_min(cause, seq) FILTER (cause IS NOT NULL) AS first_cause FROM causes GROUP BY 1""", "photos", "projects", also=_CAUSES))
def render_report(spark, sf):
    return ST.report(_causes(spark, sf))


@query("render_report_abort", fx.sql("""
  SELECT project_id, count(*) FILTER (cause IS NULL) AS completed, count(cause) AS failed, arg_min(cause, seq) FILTER (cause IS NOT NULL) AS first_cause
  FROM causes c LEFT JOIN (SELECT project_id, min(seq) AS stop FROM causes WHERE cause IS NOT NULL GROUP BY 1) s USING (project_id) WHERE stop IS NULL OR seq <= stop GROUP BY 1""", "photos", "projects", also=_CAUSES))
def render_report_abort(spark, sf):
    return ST.report(_causes(spark, sf), go_on=False)
