"""Registered queries: recipe graphs checked, pruned and edited."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shootlake.operators import recipes as RE
from shootlake.operators import settings as S
from shootlake.plans import fixtures as fx
from shootlake.plans.registry import query
from shootlake.session import ensure_checkpoint_dir

_W = "(PARTITION BY recipe_id ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def checked(source, linked="true"):
    """Errors per node of a chain: what each rule says given the nodes above it that are linked to it."""
    return f"""SELECT *, CASE WHEN kind = 'mystery' THEN ['kind'] ELSE [] END AS e_kind,
      coalesce(domain_above = 'film', false) AND kind NOT IN ('film', 'crop', 'rotate', 'node') AS e_domain,
      kind = 'optics' AND NOT bypassed AND moved > 0 AS e_optics, kind = 'blend' AND NOT bypassed AND moved > 0 AS e_geometry FROM (
      SELECT *, coalesce(sum(CASE WHEN kind IN ('crop', 'rotate') AND NOT bypassed AND {linked} THEN 1 ELSE 0 END) OVER {_W}, 0) AS moved,
             last_value(CASE WHEN kind NOT IN ('crop', 'rotate', 'node') AND {linked} THEN kind END IGNORE NULLS) OVER {_W} AS domain_above FROM {source})"""


def _recipes(spark, sf):
    return fx.recipes(spark, sf)


def sound(spark, sf):
    """Well-formed recipes only; an order of more than 64 lines is none."""
    return _recipes(spark, sf).withColumn("errors", RE.errors(F.col("recipe"), F.col("recipe_output"))).where("size(errors) = 0").drop("errors")


# Word lists as the fold reports them: node by node, each node's in this order, then the output.
_FLAWS = {
    "flaws": checked("nodes", "broken <> 0"),
    "words": """SELECT recipe_id, rid, output, list_filter([CASE WHEN broken = 0 THEN 'order' END,
        CASE WHEN broken = 1 OR (rid = 2 AND recipe_id % 7 = 0 AND recipe_id // 7 % 6 = 0) THEN 'upstream' END, CASE WHEN kind = 'mystery' THEN 'kind' END,
        CASE WHEN broken = 2 OR (broken IN (1, 4) AND kind0 = 'blend') THEN 'arity' END, CASE WHEN broken = 3 OR (broken = 4 AND len(params) > 0) THEN 'params' END,
        CASE WHEN e_domain AND broken NOT IN (1, 2) THEN 'domain' END, CASE WHEN e_optics THEN 'optics' END, CASE WHEN e_geometry THEN 'geometry' END], lambda w: w IS NOT NULL) AS w
      FROM (SELECT *, CASE WHEN kind0 IN ('blend', 'curves', 'node') THEN [] ELSE [1] END AS params FROM flaws)""",
    "sentence": """SELECT recipe_id, array_to_string(flatten(list(w ORDER BY rid)) || CASE WHEN recipe_id % 7 = 0 AND (recipe_id // 7 % 6 = 5
        OR recipe_id // 7 % 6 = 0 AND max(output) = 1) THEN ['output'] ELSE [] END, ' ') AS errors FROM words GROUP BY recipe_id""",
    "good": "SELECT recipe_id FROM sentence WHERE errors = ''",
}


@query("recipe_errors", fx.sql("SELECT recipe_id, errors FROM sentence", "nodes", also=_FLAWS))
def recipe_errors(spark, sf):
    r = _recipes(spark, sf)
    large = fx.oversized(spark, sf).select("recipe_id", F.lit("size").alias("errors"))
    return r.select("recipe_id", F.array_join(RE.errors(F.col("recipe"), F.col("recipe_output")), " ").alias("errors")).unionByName(large)


@query("recipe_flat", fx.sql("SELECT recipe_id, id, kind, bypassed, round(opacity, 6) AS opacity FROM nodes", "nodes"))
def recipe_flat(spark, sf):
    n = fx.recipe_nodes(spark, sf)
    return n.select("recipe_id", F.col("n.id").cast("long").alias("id"), "n.kind", "n.bypassed", F.round("n.opacity", 6).alias("opacity"))


@query("recipe_param_violations", fx.sql("""
  SELECT recipe_id, id AS node, 'bogus' AS setting FROM nodes WHERE broken = 3
  UNION ALL SELECT recipe_id, id, unnest(CASE kind0 """ + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(p) for p in ps)}]" for k, ps in fx._NODE_PARAMS.items()) + " ELSE CAST([] AS VARCHAR[]) END) FROM nodes WHERE broken = 4", "nodes"))
def recipe_param_violations(spark, sf):
    return RE.violations(fx.recipe_nodes(spark, sf).select("recipe_id", F.array("n").alias("recipe")), "recipe_id").withColumn("node", F.col("node").cast("long"))


# Nodes whose numbers come from order lines, so that every rule of a range, rectangle, turn and curve is met and broken.
_FAULTS = """
  WITH l AS (SELECT l_orderkey AS recipe_id, l_linenumber AS node, l_partkey % 6 AS k, l_partkey % 13 AS a, l_suppkey % 11 AS b,
      CAST(l_partkey % 13 AS DOUBLE) / 10 AS x, CAST(l_suppkey % 11 AS DOUBLE) / 10 AS y,
      CAST(l_partkey % 13 AS DOUBLE) / 10 + CAST(l_suppkey % 11 AS DOUBLE) / 1000
        - CASE WHEN l_suppkey % 11 = 1 THEN CAST(5e-10 AS DOUBLE) ELSE 0 END AS z FROM lineitem),
  v AS (SELECT recipe_id, node, unnest(CASE k
      WHEN 0 THEN [CASE WHEN x > 1 THEN 'left' END, CASE WHEN y < CAST(0.05 AS DOUBLE) THEN 'width' END,
                   CASE WHEN 10 * (CAST(a AS DOUBLE) - 6) NOT BETWEEN -45 AND 45 THEN 'angle' END,
                   CASE WHEN x + y > CAST(1.0001 AS DOUBLE) THEN 'rectangle' END]
      WHEN 1 THEN [CASE WHEN CAST(a AS DOUBLE) / 2 - 1 NOT BETWEEN 0 AND 3 THEN 'quarter_turns' END, CASE WHEN a % 2 = 1 THEN 'quarter_turns' END]
      WHEN 2 THEN [CASE WHEN 5 * y NOT BETWEEN CAST(0.2 AS DOUBLE) AND 4 THEN 'contrast' END,
                   CASE WHEN x NOT BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.95 AS DOUBLE) THEN 'pivot' END]
      WHEN 3 THEN [CASE WHEN a > 3 THEN 'amount' END, CASE WHEN y < CAST(0.3 AS DOUBLE) THEN 'radius' END, CASE WHEN b > 8 THEN 'threshold' END]
      WHEN 4 THEN [CASE WHEN a > 4 THEN 'red' END, CASE WHEN b = 0 THEN 'green' END, CASE WHEN b = 1 THEN 'opacity' END]
      ELSE [CASE WHEN b > 7 OR x > 1 OR z > 1 OR b = 6 OR NOT x > CAST(0.001 AS DOUBLE)
                   OR NOT z - x {gap} THEN CASE WHEN b > 7 THEN 'luma' ELSE 'red' END END] END) AS setting FROM l)
  SELECT recipe_id, node, setting FROM v WHERE setting IS NOT NULL"""


def _faulty_nodes(spark, sf):
    line = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS recipe_id", "l_linenumber AS id", "l_partkey % 6 AS k", "l_partkey % 13 AS a", "l_suppkey % 11 AS b")
    made = line.selectExpr("*", "double(a) / 10 AS x", "double(b) / 10 AS y", "double(a) / 10 + double(b) / 1000 - if(b = 1, 5e-10D, 0D) AS z").selectExpr(
        "recipe_id", "id", "element_at(array('crop', 'rotate', 'contrast', 'sharpen', 'color_subtract', 'curves'), int(k) + 1) AS kind",
        """CASE k WHEN 0 THEN map('left', x, 'width', y, 'angle', 10 * (double(a) - 6)) WHEN 1 THEN map('quarter_turns', double(a) / 2 - 1)
           WHEN 2 THEN map('contrast', 5 * y, 'pivot', x) WHEN 3 THEN map('amount', double(a), 'radius', y, 'threshold', double(b))
           WHEN 4 THEN map('red', double(a), if(b = 1, 'opacity', 'green'), if(b = 0, NULL, 1D)) ELSE cast(map() AS map<string, double>) END AS params""",
        """CASE WHEN k = 5 THEN map(if(b > 7, 'luma', 'red'), slice(array(0D, 0D, x, x, z, 1D), 1, if(b = 6, 5, 6)))
           ELSE cast(map() AS map<string, array<double>>) END AS points""")
    return made.select("recipe_id", F.array(F.struct("id", "kind", "params", "points")).alias("recipe"))


@query("node_faults", _FAULTS.format(gap="> CAST(0.001 AS DOUBLE)"))
def node_faults(spark, sf):
    return RE.violations(_faulty_nodes(spark, sf), "recipe_id", render=False)


@query("node_render_faults", _FAULTS.format(gap=">= CAST(0.001 AS DOUBLE) - CAST(1e-9 AS DOUBLE)").replace(
    "NOT x > CAST(0.001 AS DOUBLE)", "NOT x >= CAST(0.001 AS DOUBLE) - CAST(1e-9 AS DOUBLE)"))
def node_render_faults(spark, sf):
    return RE.violations(_faulty_nodes(spark, sf), "recipe_id", render=True)


def text(nodes):
    return F.array_join(F.transform(nodes, lambda n: F.concat(n["id"].cast("string"), F.lit(":"), n["kind"], F.when(n["bypassed"], F.lit("*")).otherwise(F.lit("")),
                                                              F.lit("("), F.array_join(n["inputs"].cast("array<string>"), ","), F.lit(")"))), " ")


def _text_sql(id_="id", kind="kind", in1="in1", in2="in2", by="id"):
    return (f"coalesce(string_agg({id_} || ':' || {kind} || CASE WHEN bypassed THEN '*' ELSE '' END || '(' || {in1} || coalesce(',' || {in2}, '') || ')', ' ' ORDER BY {by}), '')")


@query("recipe_effective", fx.sql(f"""
  SELECT g.recipe_id, {_text_sql()} AS recipe, coalesce(max(id), 0) AS output FROM good g LEFT JOIN (
    SELECT recipe_id, id, kind, bypassed, in2, coalesce(lag(id) OVER (PARTITION BY recipe_id ORDER BY id), 0) AS in1 FROM nodes
    WHERE NOT bypassed AND kind <> 'node' AND id <= output) e ON e.recipe_id = g.recipe_id GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_effective(spark, sf):
    r = sound(spark, sf).withColumn("e", RE.effective(F.col("recipe"), F.col("recipe_output")))
    return r.select("recipe_id", text(F.col("e.nodes")).alias("recipe"), F.col("e.output").cast("long").alias("output"))


@query("recipe_consumers", fx.sql("""
  SELECT g.recipe_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS source_readers FROM good g JOIN nodes USING (recipe_id)
  WHERE in1 = 0 OR in2 = 0 GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_consumers(spark, sf):
    return sound(spark, sf).select("recipe_id", F.array_join(RE.consumers(F.col("recipe"), F.lit(0)).cast("array<string>"), ",").alias("source_readers"))


def edited_sql(body):
    """Edited chains (recipe_id, rid, kind, bypassed, in1, in2, n, output), kept where every rule still holds."""
    return {**_FLAWS, "edited": body,
            "spoilt": f"SELECT DISTINCT recipe_id FROM ({checked('edited')}) WHERE e_domain OR e_optics OR e_geometry",
            "outcome": """SELECT recipe_id, rid AS id, kind, bypassed, in1, in2, output, true AS applied FROM edited WHERE recipe_id IN (SELECT recipe_id FROM good) AND recipe_id NOT IN (SELECT recipe_id FROM spoilt)
              UNION ALL SELECT recipe_id, id, kind, bypassed, in1, in2, output, false FROM nodes WHERE recipe_id IN (SELECT recipe_id FROM good)
              AND (recipe_id IN (SELECT recipe_id FROM spoilt) OR recipe_id NOT IN (SELECT recipe_id FROM edited))"""}


_OUTCOME = f"SELECT recipe_id, {_text_sql()} AS recipe, max(output) AS output, bool_or(applied) AS applied FROM outcome GROUP BY 1"


def outcome(df):
    return df.select("recipe_id", text(F.col("recipe")).alias("recipe"), F.col("recipe_output").cast("long").alias("output"), "applied")


def _half(c="recipe_output"):
    return F.floor((F.col(c) + 1) / 2).cast("int")


_AT = "(output + 1) // 2"


def _insert_sql(kind, second="NULL"):
    return f"""SELECT recipe_id, rid, kind, bypassed, rid - 1 AS in1, in2, output FROM (
      SELECT recipe_id, CASE WHEN rid > {_AT} THEN rid + 1 ELSE rid END AS rid, kind, bypassed, in2, CASE WHEN output = {_AT} THEN output + 1 ELSE output + 1 END AS output FROM nodes
      UNION ALL SELECT recipe_id, {_AT} + 1, '{kind}', false, {second}, output + 1 FROM nodes WHERE rid = 1)"""


@query("recipe_insert", fx.sql(_OUTCOME, "nodes", also=edited_sql(_insert_sql("contrast"))))
def recipe_insert(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.insert_after(_half(), "contrast")))


@query("recipe_insert_blend", fx.sql(_OUTCOME, "nodes", also=edited_sql(_insert_sql("blend", "0"))))
def recipe_insert_blend(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.insert_after(_half(), "blend")))


@query("recipe_delete", fx.sql(f"""
  SELECT g.recipe_id, {_text_sql()} AS recipe, coalesce(max(output), 0) AS output, coalesce(bool_or(applied), true) AS applied
  FROM good g LEFT JOIN (SELECT * FROM outcome WHERE recipe_id NOT IN (SELECT recipe_id FROM nodes WHERE n = 1)) USING (recipe_id) GROUP BY 1""",
    "nodes", also=edited_sql(f"""
  SELECT recipe_id, CASE WHEN rid > {_AT} THEN rid - 1 ELSE rid END AS rid, kind, bypassed, CASE WHEN rid > {_AT} THEN rid - 2 ELSE rid - 1 END AS in1, in2, output - 1 AS output
  FROM nodes WHERE rid <> {_AT}""")))
def recipe_delete(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.delete(_half())))


@query("recipe_swap", fx.sql(_OUTCOME, "nodes", also=edited_sql("""
  SELECT recipe_id, CASE rid WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE rid END AS rid, kind, bypassed, CASE rid WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE rid - 1 END AS in1, in2, CASE output WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE output END AS output
  FROM nodes WHERE recipe_id IN (SELECT recipe_id FROM nodes GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (rid <= 2 AND kind IN ('blend', 'film')) = 0)""")))
def recipe_swap(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.swap_with_upstream(F.lit(2))))


@query("recipe_move", fx.sql(_OUTCOME, "nodes", also=edited_sql("""
  SELECT recipe_id, CASE WHEN rid = 1 THEN output WHEN rid <= output THEN rid - 1 ELSE rid END AS rid, kind, bypassed,
         CASE WHEN rid = 1 THEN output - 1 WHEN rid <= output THEN rid - 2 ELSE rid - 1 END AS in1, in2, output FROM nodes WHERE output > 1""")))
def recipe_move(spark, sf):
    """The first node is spliced out and put at the output."""
    return outcome(RE.edit(sound(spark, sf), RE.move_after(F.lit(1), F.col("recipe_output"))))


# The nodes from the third on no longer stand below the first two: each part is checked as a chain of its own.
_REWIRED = edited_sql("""
  SELECT recipe_id, rid, kind, bypassed, CASE WHEN rid = 3 THEN 0 ELSE in1 END AS in1, in2, output FROM nodes
  WHERE recipe_id IN (SELECT recipe_id FROM nodes WHERE rid = 3)""")
_REWIRED["spoilt"] = f"""SELECT DISTINCT recipe_id // 2 AS recipe_id FROM ({checked(
    "(SELECT * REPLACE (recipe_id * 2 + CAST(rid >= 3 AS BIGINT) AS recipe_id) FROM edited)")}) WHERE e_domain OR e_optics OR e_geometry"""


@query("recipe_rewire", fx.sql(_OUTCOME, "nodes", also=_REWIRED))
def recipe_rewire(spark, sf):
    """The third node reads the source; what stood above it stays, unread."""
    return outcome(RE.edit(sound(spark, sf), RE.rewire(F.lit(3), F.lit(0))))


@query("recipe_set_output", fx.sql(f"""
  SELECT recipe_id, {_text_sql()} AS recipe, CASE WHEN max(output) <> 1 THEN 1 ELSE max(output) END AS output, max(output) <> 1 AS applied
  FROM nodes JOIN good USING (recipe_id) GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_set_output(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.set_output(F.lit(1))))


@query("recipe_retype", fx.sql(_OUTCOME, "nodes", also=edited_sql("""
  SELECT recipe_id, rid, CASE WHEN rid = 1 THEN 'blend' ELSE kind END AS kind, bypassed, in1, CASE WHEN rid = 1 THEN 0 ELSE in2 END AS in2, output FROM nodes
  WHERE recipe_id IN (SELECT recipe_id FROM nodes WHERE rid = 1 AND kind <> 'blend')""")))
def recipe_retype(spark, sf):
    return outcome(RE.edit(sound(spark, sf), RE.retype(F.lit(1), "blend")))


@query("recipe_retype_back", fx.sql(f"""
  SELECT recipe_id, {_text_sql()} AS recipe, sum(opacity) FILTER (id = 1) AS first_opacity FROM nodes JOIN good USING (recipe_id) WHERE recipe_id IN (
    SELECT recipe_id FROM nodes WHERE rid = 1 AND kind = 'blend') GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_retype_back(spark, sf):
    """A blend turned into an untyped node and back comes back as it was."""
    r = sound(spark, sf).where("recipe[0].kind = 'blend'")
    there = RE.edit(r, RE.retype(F.lit(1), "node")).drop("applied")
    back = RE.edit(there, RE.retype(F.lit(1), "blend"))
    return back.select("recipe_id", text(F.col("recipe")).alias("recipe"), F.expr("recipe[0].opacity").alias("first_opacity"))


@query("recipe_without_optics", fx.sql("""
  SELECT recipe_id, count(*) FILTER (bypassed OR kind = 'optics') AS bypassed_nodes FROM nodes JOIN good USING (recipe_id) GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_without_optics(spark, sf):
    n = RE.without_kinds(F.col("recipe"), ["optics"])
    return sound(spark, sf).select("recipe_id", F.size(F.filter(n, lambda x: x["bypassed"])).cast("long").alias("bypassed_nodes"))


@query("recipe_insertion_point", fx.sql("""
  SELECT recipe_id, max(CASE WHEN id <= output AND domain <> 'film' THEN id ELSE 0 END) AS position, max(CASE WHEN id <= output AND kind <> 'film' THEN id ELSE 0 END) AS tail_linear,
         max(CASE WHEN kind = 'tone' THEN id END) AS last_tone FROM (
    SELECT *, coalesce(last_value(CASE WHEN kind NOT IN ('crop', 'rotate', 'node') THEN kind END IGNORE NULLS) OVER (PARTITION BY recipe_id ORDER BY rid ROWS UNBOUNDED PRECEDING), 'source') AS domain FROM nodes)
  JOIN good USING (recipe_id) GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_insertion_point(spark, sf):
    r = sound(spark, sf)
    return r.select("recipe_id", RE.insertion_point(F.col("recipe"), F.col("recipe_output"), "exposure").cast("long").alias("position"),
                    RE.tail_linear(F.col("recipe"), F.col("recipe_output")).cast("long").alias("tail_linear"),
                    RE.last_covering(F.col("recipe"), "tone").cast("long").alias("last_tone"))


@query("recipe_insertable_kinds", fx.sql("""
  SELECT recipe_id, array_to_string(list_filter([CASE WHEN lin THEN 'white_balance' END, CASE WHEN lin THEN 'exposure' END, CASE WHEN lin THEN 'noise_reduction' END, CASE WHEN lin THEN 'tone' END,
      CASE WHEN lin AND still THEN 'optics' END, CASE WHEN NOT rest_linear THEN 'film' END, CASE WHEN lin AND still THEN 'blend' END, CASE WHEN lin THEN 'color_subtract' END, CASE WHEN lin THEN 'contrast' END,
      CASE WHEN lin THEN 'sharpen' END, CASE WHEN NOT rest_still THEN 'crop' END, CASE WHEN NOT rest_still THEN 'rotate' END, CASE WHEN lin THEN 'curves' END], lambda k: k IS NOT NULL), ',') AS kinds FROM (
    SELECT recipe_id, bool_or(id = output AND domain <> 'film') AS lin, bool_or(id = output AND moved = 0) AS still,
           bool_or(id > output AND kind NOT IN ('film', 'crop', 'rotate', 'node')) AS rest_linear, bool_or(id > output AND NOT bypassed AND kind IN ('optics', 'blend')) AS rest_still FROM (
      SELECT *, coalesce(last_value(CASE WHEN kind NOT IN ('crop', 'rotate', 'node') THEN kind END IGNORE NULLS) OVER (PARTITION BY recipe_id ORDER BY rid ROWS UNBOUNDED PRECEDING), 'source') AS domain,
             sum(CASE WHEN kind IN ('crop', 'rotate') AND NOT bypassed THEN 1 ELSE 0 END) OVER (PARTITION BY recipe_id ORDER BY rid ROWS UNBOUNDED PRECEDING) AS moved FROM nodes)
    JOIN good USING (recipe_id) GROUP BY 1)""", "nodes", also=_FLAWS))
def recipe_insertable_kinds(spark, sf):
    kinds = RE.insertable(F.col("recipe"), F.col("recipe_output"), F.col("recipe_output"))
    return sound(spark, sf).select("recipe_id", F.array_join(kinds, ",").alias("kinds"))


@query("recipe_active_optics", fx.sql("""
  SELECT recipe_id, bool_or(NOT bypassed AND id <= output AND kind = 'optics' AND q % 2 = 1) AS active FROM nodes JOIN good USING (recipe_id) GROUP BY 1""", "nodes", also=_FLAWS))
def recipe_active_optics(spark, sf):
    return sound(spark, sf).select("recipe_id", RE.active_optics(F.col("recipe"), F.col("recipe_output")).alias("active"))


@query("recipe_packed", fx.sql("""
  SELECT recipe_id, id, unnest(range(0, len(p))) AS place, round(unnest(p), 6) AS value FROM (SELECT recipe_id, id, CAST(CASE kind WHEN 'white_balance' THEN [3000 + 100 * q, d * 100 - 5]
      WHEN 'exposure' THEN [d * 20 - 1] WHEN 'noise_reduction' THEN [d * 5, 0] WHEN 'tone' THEN [0, t * 10, 0, 0, 0, 0, 0] WHEN 'optics' THEN [q % 2, d * 10, 0]
      WHEN 'film' THEN [CASE WHEN q % 2 = 0 THEN d * 10 ELSE 0 END, t * 5, 1] WHEN 'blend' THEN [opacity] WHEN 'color_subtract' THEN [t * 20, 1, d]
      WHEN 'contrast' THEN [0.5 + d * 10, 0.435] WHEN 'sharpen' THEN [d * 10, 1 + t * 10, 2] WHEN 'crop' THEN [d, t, 0.5 + t, 0.5, 0]
      WHEN 'rotate' THEN [q % 4] WHEN 'curves' THEN [3, 2, 2, 2, 0, 0, 0.5, 0.5 + d, 1, 1, 0, 0, 1, 1, 0, 0, 1, 1, 0, 0, 1, 1] END AS DOUBLE[]) AS p
    FROM nodes JOIN good USING (recipe_id) WHERE kind <> 'node')""", "nodes", also=_FLAWS))
def recipe_packed(spark, sf):
    n = sound(spark, sf).select("recipe_id", F.explode("recipe").alias("n")).withColumn("p", RE.packed(F.col("n"))).where("p IS NOT NULL")
    return n.select("recipe_id", F.col("n.id").cast("long").alias("id"), F.posexplode("p").alias("place", "value")).select(
        "recipe_id", "id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("recipe_render_classes", fx.sql("""
  SELECT recipe_id, min(recipe_id) OVER (PARTITION BY chain) AS renders_as FROM (
    SELECT g.recipe_id, string_agg(step, '|' ORDER BY id) AS chain FROM good g LEFT JOIN (
      SELECT recipe_id, id, kind || CAST(opacity AS VARCHAR) || CAST(CASE kind WHEN 'white_balance' THEN [q, d] WHEN 'exposure' THEN [d] WHEN 'noise_reduction' THEN [d]
        WHEN 'tone' THEN [t] WHEN 'optics' THEN [q % 2, d] WHEN 'film' THEN [q % 2, d, t] WHEN 'color_subtract' THEN [t, d] WHEN 'contrast' THEN [d] WHEN 'sharpen' THEN [d, t]
        WHEN 'crop' THEN [d, t] WHEN 'rotate' THEN [q % 4] WHEN 'curves' THEN [d] ELSE [] END AS VARCHAR) AS step
      FROM nodes WHERE NOT bypassed AND kind <> 'node' AND id <= output) n ON n.recipe_id = g.recipe_id GROUP BY 1)""", "nodes", also=_FLAWS))
def recipe_render_classes(spark, sf):
    """The first recipe with the same render key, which covers the effective graph and its LUTs' content."""
    from shootlake.plans.queries.apply import lut_cubes
    film = lut_cubes(spark, sf).where("lut_id = '0'").agg(F.max(F.sha2("text", 256))).scalar()
    contents = F.create_map(F.lit("luts/film.cube"), F.coalesce(film, F.lit("absent")))
    eff = RE.effective(F.col("recipe"), F.col("recipe_output"))
    known = sound(spark, sf).withColumns({"e": eff, "contents": contents})
    keys = known.select("recipe_id", S.graph_render_key(F.col("e"), F.col("contents"), F.lit("2048x2048q88")).alias("key"))
    # read twice, so written once
    path = f"{ensure_checkpoint_dir(spark)}/render-keys-{uuid.uuid4().hex}"
    keys.write.parquet(path)
    keyed = spark.read.schema(keys.schema).parquet(path)
    first = keyed.groupBy("key").agg(F.min("recipe_id").alias("renders_as"))
    return keyed.join(first, "key").select("recipe_id", "renders_as")


@query("grain_ordinals", fx.sql("""
  SELECT recipe_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS grainy FROM (
    SELECT g.recipe_id, n.id FROM good g LEFT JOIN nodes n ON n.recipe_id = g.recipe_id AND kind = 'film' AND NOT bypassed AND t > 0 AND id <= output) GROUP BY 1""", "nodes", also=_FLAWS))
def grain_ordinals(spark, sf):
    r = sound(spark, sf).withColumn("e", RE.effective(F.col("recipe"), F.col("recipe_output")))
    return r.select("recipe_id", F.array_join(RE.grain_ordinals(F.col("e.nodes")).cast("array<string>"), ",").alias("grainy"))
