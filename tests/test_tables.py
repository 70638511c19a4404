"""Sources, sinks, names, settings and recipes on small hand-made tables."""

import json
import random

from pyspark.sql import functions as F

from shootlake.functions import text as T
from shootlake.operators import catalogue, focus, lenses, recipes, settings, store
from shootlake.sources import files, luts, tables


def test_ratings_and_times(spark):
    rows = [(i, v) for i, v in enumerate(["0", "-", None, "6", "3", "5", "4 stars", "unknown"])]
    df = spark.createDataFrame(rows, "i int, v string")
    got = [r["n"] for r in df.select("i", T.star_rating(T.usable(F.col("v"))).alias("n")).orderBy("i").collect()]
    assert got == [None, None, None, None, 3, 5, 4, None]
    days = spark.createDataFrame([(0, "2026:08:02 18:35:12"), (1, "not a date"), (2, "1970:01:01 00:00:00"), (3, "2024:02:31 00:00:00")], "i int, v string")
    got = [r["s"] for r in days.select("i", T.capture_seconds(T.digits(F.col("v"))).alias("s")).orderBy("i").collect()]
    assert got[1] is None and got[2] == T.EPOCH_1900 and got[3] - T.EPOCH_1900 == 1709337600
    assert got[0] - T.EPOCH_1900 == 1785695712


def test_focus_verdicts(spark):
    rows = [(None, None), (0.5, 0.5), (1.2, 0.5), (1.1, 0.5), (3.0, 0.05), (3.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, blur double, judgeable double")
    got = [r["verdict"] for r in focus.with_verdicts(df).orderBy("i").collect()]
    assert got == ["unknown", "sharp", "soft", "sharp", "unknown", "unknown"]


def test_one_byte_changes_the_key(spark):
    a = bytes(37 * i % 256 for i in range(5000))
    b = a[:4000] + bytes([a[4000] ^ 1]) + a[4001:]
    df = spark.createDataFrame([("x", a, 1), ("y", bytearray(a), 2), ("z", bytearray(b), 3)], "path string, content binary, length int")
    got = sorted((r["path"], r["copies"]) for r in catalogue.same_content(df).collect())
    assert got == [("x", 2), ("z", 1)]


def test_retention_in_slices(spark):
    rng = random.Random(1)
    day = 86400
    rows = [(i, rng.randrange(1, 50), rng.choice([0, 10, 44, 45, 46]) * day + rng.choice([0, 5])) for i in range(200)]
    now = 46 * day
    df = spark.createDataFrame(rows, "file_id long, size long, written long")
    kept, total = set(), 0
    for i, size, written in sorted((r for r in rows if r[2] >= now - 45 * day), key=lambda r: (-r[2], r[0])):
        total += size
        if total <= 2500:
            kept.add(i)
    for width in (1, 16, 1 << 20):
        assert {r["file_id"] for r in catalogue.retained(df, now, max_bytes=2500, width=width).collect()} == kept


def test_free_names_against_brute_force(spark):
    rng = random.Random(2)
    stems = ["foo", "foo", "foo-2", "foo-2-2", "foo-3", "bar", "foo-10", "foo-02", "bar-2", "baz"]
    rows = [(rng.randrange(2), seq, rng.choice(stems), "set.jpg" if rng.random() < .1 else None, True) for seq in range(120)]
    df = spark.createDataFrame(rows, "project_id long, seq long, auto_stem string, output string, timestamp_names boolean")
    taken, want = {0: set(), 1: set()}, {}
    for project, seq, stem, output, _ in rows:
        name = stem
        if output is None:
            n = 2
            while name in taken[project]:
                name, n = f"{stem}-{n}", n + 1
            taken[project].add(name)
        want[seq] = name
    for width in (7, 1 << 20):
        assert {r["seq"]: r["final_stem"] for r in store.free_stems(df, width).collect()} == want


def test_next_still_fills_the_gap(spark):
    photos = spark.createDataFrame([(1, 10, "/c/P1.ORF"), (1, 11, "/c/P2.ORF")], "project_id long, photo_id long, input string")
    presets = spark.createDataFrame([(1, "Still 001 (P1)"), (1, "still 002 (p1)"), (1, "Still 004 (P1)"), (1, "other")], "project_id long, name string")
    got = {r["photo_id"]: r["still"] for r in store.next_still_name(photos, presets).collect()}
    assert got == {10: "Still 003 (P1)", 11: "Still 001 (P2)"}


def test_cube_files(spark, tmp_path):
    entries = [f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    good = "# film\nTITLE \"x\"\nLUT_3D_SIZE 2\nDOMAIN_MAX 1 1 2\n" + "\n".join(entries) + "\n"
    cases = {"good": good, "short": good.replace("1 1 1", ""), "twice": good.replace("DOMAIN", "LUT_3D_SIZE 2\nDOMAIN"),
             "nan": good.replace("1 1 1", "1 1 nan"), "other": good.replace("DOMAIN_MAX", "SHAPER"), "late": "\n".join(entries) + "\nLUT_3D_SIZE 2\n",
             "flat": good.replace("DOMAIN_MAX 1 1 2", "DOMAIN_MAX 1 0 2")}
    for name, body in cases.items():
        (tmp_path / f"{name}.cube").write_text(body)
    fine, bad = luts.parse(luts.read_cubes(spark, str(tmp_path)))
    rows = fine.collect()
    assert [r["lut_id"].split("/")[-1] for r in rows] == ["good.cube"] and rows[0]["dmax"] == [1.0, 1.0, 2.0]
    problems = {r["lut_id"].split("/")[-1].split(".")[0]: r["problems"] for r in bad.collect()}
    assert set(problems) == set(cases) - {"good"} and problems["flat"] == ["domain"] and "order" in problems["late"]
    point = luts.lattice(fine).where("ri = 1 AND gi = 0 AND bi = 1").first()
    assert (point["r"], point["g"], point["b"]) == (1.0, 0.0, 1.0)


def test_files_and_pixels_round_trip(spark, tmp_path):
    (tmp_path / "card").mkdir()
    (tmp_path / "card" / "a.raw").write_bytes(b"abc")
    rows = files.scan(spark, str(tmp_path / "card"), "*.raw").collect()
    assert [(r["length"], bytes(r["content"])) for r in rows] == [(3, b"abc")]
    listed = files.scan(spark, str(tmp_path / "card"), content=False)
    assert catalogue.trusted(listed, F.current_timestamp() + F.expr("INTERVAL 5 SECONDS")).count() == 1
    assert catalogue.changed_since(listed, listed).count() == 0
    px = spark.createDataFrame([(7, y, x, 0.1, 0.2, 0.3) for y in range(4) for x in range(4)], tables.PIXELS)
    tables.write_pixels(px, str(tmp_path / "px"), 4)
    back = tables.read_pixels(spark, str(tmp_path / "px")).where("image_bucket = 3 AND image_id = 7 AND y = 2").select("x", "r")
    assert back.count() == 4
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(image_id,7)" in plan


def test_projects_take_defaults(spark, tmp_path):
    lines = [{"project_id": 1, "version": 1, "output_dir": "out", "defaults": {}, "photos": [{"photo_id": 5, "input": "a.orf"}]},
             {"project_id": 2, "version": 9, "output_dir": "out", "defaults": {}, "photos": []}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    projects, photos = tables.read_projects(spark, str(tmp_path / "p.json"))
    row = projects.first()
    assert projects.count() == 1 and row["export"]["format"] == "jpeg" and row["export"]["quality"] == 92
    assert photos.first()["overrides"] == {} and photos.first()["disabled"] == []
    with open(tmp_path / "p.json", "a") as more:
        more.write('\n{"project_id": 3, "versi\n\n{"version": 2, "mood": 1, "zeal": 2}\n')
    problems = {(r["line"][:16], r["problem"]) for r in tables.project_violations(spark, str(tmp_path / "p.json")).collect()}
    assert {p for _, p in problems} == {"version", "malformed", "unknown key mood", "unknown key zeal"} and len(problems) == 4


def test_render_keys_follow_recipe_and_luts(spark):
    def nodes(exposure, lut, first=1):
        ev = F.create_map(F.lit("exposure"), F.lit(exposure))
        film = F.create_map(F.lit("lut_strength"), F.lit(0.5))
        return F.array(recipes.node("exposure", F.array(F.lit(0)), ev, 1.0, F.lit(first)),
                       recipes.node("film", F.array(F.lit(first)), film, 1.0, F.lit(first + 1)).withField("lut", F.lit(lut))).cast(tables.RECIPE)

    def digests(exposure, lut, contents, first=1, shape="jpeg"):
        eff = recipes.effective(nodes(exposure, lut, first), F.lit(first + 1))
        known = F.create_map(*[F.lit(x) for kv in contents.items() for x in kv])
        row = spark.range(1).select(settings.node_keys(eff, known).alias("k"), settings.graph_render_key(eff, known, F.lit(shape)).alias("key")).first()
        return row["k"][first], row["key"]
    base = digests(0.5, "a", {"a": "1"})
    others = [digests(0.6, "a", {"a": "1"}), digests(0.5, "b", {"a": "1"}), digests(0.5, "a", {"a": "2"}), digests(0.5, "a", {"a": "1"}, shape="tiff")]
    assert len({base[1], *[k for _, k in others]}) == 5
    # the same content under another name, and the same nodes under other ids, are the same render
    assert base == digests(0.5, "b", {"b": "1"}) == digests(0.5, "a", {"a": "1"}, first=7)
    # what comes before a difference keeps its digest
    assert base[0] == others[1][0] == others[2][0] != others[0][0]


def test_deleted_stills(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2)], "name string, written long")
    assert [r["name"] for r in store.delete_stills(held, spark.createDataFrame([("b",), ("z",)], "name string")).collect()] == ["a"]


def test_results_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "project_id long, v string")
    store.write_results(frame([(1, "a"), (2, "b")]), path)
    try:
        store.write_results(frame([(1, "c")]), path)
        raise AssertionError("an existing output must be refused")
    except Exception as e:
        assert "exist" in str(e).lower()
    store.write_results(frame([(1, "c")]), path, replace=True)
    assert sorted((r["project_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "c"), (2, "b")]


def test_results_of_many_projects(spark, tmp_path):
    path = tmp_path / "out"
    frame = lambda ids, v: spark.createDataFrame([(i, f"{v}{i}") for i in ids], "project_id long, v string")
    store.write_results(frame(range(2000), "a"), str(path))
    assert len([p for p in path.iterdir() if p.is_dir()]) <= store.RESULT_BUCKETS
    store.write_results(frame(range(5, 2500, 5), "b").unionByName(frame([7], "c")).unionByName(frame([7], "d")), str(path), replace=True)
    want = [(i, f"a{i}") for i in range(2000) if i % 5 and i != 7 or i == 0] + [(i, f"b{i}") for i in range(5, 2500, 5)] + [(7, "c7"), (7, "d7")]
    assert sorted((r["project_id"], r["v"]) for r in spark.read.parquet(str(path)).collect()) == sorted(want)
    empty, absent = str(tmp_path / "empty"), str(tmp_path / "absent")
    store.write_results(frame([1], "a").where("false"), empty)
    for place in (empty, absent):
        store.write_results(frame([1], "b"), place, replace=True)
        assert [r["v"] for r in spark.read.parquet(place).collect()] == ["b1"]
    store.write_results(spark.createDataFrame([(2, 0.5)], "project_id long, w double"), absent, replace=True)
    rows = spark.read.option("mergeSchema", "true").parquet(absent).collect()
    assert sorted((r["project_id"], r["v"], r["w"]) for r in rows) == [(1, "b1", None), (2, None, 0.5)]


def test_settings_become_a_recipe(spark):
    base = settings.overlay(settings.defaults(), F.create_map(
        F.lit("exposure"), settings.setting("exposure", 0.5), F.lit("noise_reduction"), settings.setting("noise_reduction", 0.4),
        F.lit("lens_correction"), settings.setting("lens_correction", False),
        F.lit("chromatic_aberration_correction"), settings.setting("chromatic_aberration_correction", False)))
    df = spark.range(1).select(settings.to_recipe(base, F.array(F.lit("noise_reduction"))).alias("recipe")).withColumn("recipe_output", F.size("recipe"))
    row = df.withColumn("e", recipes.effective(F.col("recipe"), F.col("recipe_output"))).first()
    assert [(n["id"], n["kind"], n["bypassed"]) for n in row["recipe"]] == [(1, "exposure", False), (2, "noise_reduction", True)]
    assert [n["kind"] for n in row["e"]["nodes"]] == ["exposure"] and row["e"]["output"] == 1
    gone = settings.overlay(settings.defaults(white_balance_temperature=5000.0), F.create_map(
        F.lit("white_balance_temperature"), settings.setting("white_balance_temperature", None)))
    assert spark.range(1).select(settings.value(gone, "white_balance_temperature").alias("v")).first()["v"] is None


def test_settings_as_rendered_build_no_maps(spark):
    from shootlake.plans.registry import QUERIES
    import __spark_entry__  # noqa: F401
    sf = "/root/testdata/sf0.001"
    for name in ("settings_as_rendered", "stage_bypass_defaults", "render_keys", "render_violations"):
        assert "map_from_arrays" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    num = lambda k, v: (k, (v, None, None))
    photos = spark.createDataFrame([(1, 1, dict([num("exposure", 11.0), num("tone_whites", float("nan")), num("grain_size", None)]), ["tone"]),
                                    (2, 1, dict([num("tone_whites", float("nan")), num("white_balance_temperature", 0.0)]), [])],
                                   f"project_id long, photo_id long, overrides {tables.SETTINGS}, disabled array<string>").selectExpr(
        "1L AS project_id", "project_id AS photo_id", "overrides", "disabled")
    projects = spark.range(1, 2).select(F.col("id").alias("project_id"), settings.defaults(exposure=0.5).alias("defaults"))
    wide = settings.bypassed_columns(photos, projects, F.col("overrides"))
    old = settings.with_effective(photos, projects).select("photo_id", *settings.wide(F.col("rendered")))
    assert [str(r) for r in wide.orderBy("photo_id").collect()] == [str(r) for r in old.orderBy("photo_id").collect()]
    assert sorted((r["photo_id"], r["setting"]) for r in settings.render_violations(wide).collect()) == [(1, "exposure"), (2, "tone_whites")]


def test_grades_are_pasted_without_sorting_photos(spark):
    import __spark_entry__ as entry
    from tests.oracle import compare, connect
    sf, query = "/root/testdata/sf0.001", entry.queries()["grade_paste"]
    assert "min_by" not in query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    ok, note = compare(spark, connect(sf), sf, "grade_paste", query, entry.oracle_sql()["grade_paste"])
    assert ok, note


def graph(spark, *nodes, output=None):
    parts = [recipes.node(k, F.array(*[F.lit(i) for i in ins]), None, 0.5 if k == "blend" else 1.0, n) for n, (k, *ins) in enumerate(nodes, 1)]
    return spark.range(1).select(F.array(*parts).cast(tables.RECIPE).alias("recipe"), F.lit(len(nodes) if output is None else output).alias("recipe_output"))


def shown(df):
    row = df.first()
    return [(n["kind"], *n["inputs"]) for n in row["recipe"]], row["recipe_output"], row["applied"]


def test_recipe_rules(spark):
    def errors(*nodes, output=None):
        return graph(spark, *nodes, output=output).select(recipes.errors(F.col("recipe"), F.col("recipe_output")).alias("e")).first()["e"]
    assert errors(("exposure", 0), ("film", 1), ("film", 2), ("rotate", 3), ("crop", 4)) == []
    assert errors(("film", 0), ("exposure", 1)) == ["domain"]
    assert errors(("crop", 0), ("optics", 1)) == ["optics"]
    assert errors(("crop", 0), ("blend", 1, 0)) == ["geometry"]
    assert errors(("crop", 0), ("crop", 0), ("blend", 1, 2)) == []
    assert errors(("exposure", 0), output=4) == ["output"]
    assert errors(("exposure", 2), ("tone", 0)) == ["upstream"]


def test_recipe_edits(spark):
    at = F.lit
    g = graph(spark, ("exposure", 0), ("tone", 1), ("film", 2))
    assert shown(recipes.edit(g, recipes.insert_after(at(1), "blend"))) == ([("exposure", 0), ("blend", 1, 0), ("tone", 2), ("film", 3)], 4, True)
    assert shown(recipes.edit(g, recipes.insert_after(at(3), "tone")))[2] is False
    assert shown(recipes.edit(g, recipes.swap_with_upstream(at(2)))) == ([("tone", 0), ("exposure", 1), ("film", 2)], 3, True)
    assert shown(recipes.edit(g, recipes.rewire(at(2), at(0)))) == ([("exposure", 0), ("tone", 0), ("film", 2)], 3, True)
    assert shown(recipes.edit(g, recipes.rewire(at(1), at(3))))[2] is False
    assert shown(recipes.edit(g, recipes.rewire(at(2), at(2))))[2] is False
    assert shown(recipes.edit(g, recipes.delete(at(3)))) == ([("exposure", 0), ("tone", 1)], 2, True)
    b = graph(spark, ("exposure", 0), ("tone", 0), ("blend", 1, 0))
    assert shown(recipes.edit(b, recipes.rewire(at(3), at(2), 1))) == ([("exposure", 0), ("tone", 0), ("blend", 1, 2)], 3, True)
    kinds = g.select(recipes.insertable(F.col("recipe"), F.col("recipe_output"), F.lit(3)).alias("k")).first()["k"]
    assert kinds == ["film", "crop", "rotate"]


def test_name_matches_find_every_pair(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    asked = {word(rng.randrange(0, 9)) for _ in range(60)}
    names = {word(rng.randrange(1, 9)) for _ in range(60)}
    got = {(r["asked"], r["name"]) for r in lenses._matches(
        spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(a, n) for a in asked for n in names if a == n or (len(n) >= 5 and (a in n or n in a))}


def test_lens_rows_do_not_meet_every_photo_of_their_name(spark):
    """50 rows of one name and 600 different photos that ask for it: rows meet the 20 focal lengths asked, not the photos."""
    rng = random.Random(6)
    rows = [(i, "Abc def", rng.choice(["", "m1", "M2", "m9"]), 0.0 if i % 3 else float(rng.randrange(10, 30)), float(rng.randrange(30, 60))) for i in range(50)]
    asked = [(f * 30 + m, "abc-DEF 2", float(10 + f), f"m{m}") for f in range(20) for m in range(30)]
    photos = spark.createDataFrame(asked, "photo_id long, lens_name string, focal double, camera_mount string")
    known = spark.createDataFrame(rows, "seq long, model string, mount string, focal_min double, focal_max double")
    mounts = spark.createDataFrame([("M3", "m1"), ("m4", "m9")], "mount string, compatible string")
    lent = {("m3", "m1"), ("m4", "m9")}
    want = {i: max((s for s, _, lm, lo, hi in rows if lo - 0.1 <= f <= hi + 0.1 and (lm.lower() in ("", cm) or (cm, lm.lower()) in lent)), default=None)
            for i, _, f, cm in asked}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lenses.match_lens(photos, known, mounts)
        got = {r["photo_id"]: r["lens"] for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def joined(node) -> list[int]:
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
        return own + [n for i in range(node.children().size()) for n in joined(node.children().apply(i))]
    assert got == want and max(joined(plan)) <= 2000


def test_orders_above_the_size_of_a_recipe(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from tests.oracle import compare
    rng = random.Random(3)
    rows = [(order, rng.randrange(1, 3000), rng.randrange(1, 60), float(rng.randrange(1, 50)), rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice("RAN"))
            for order, n in ((1, 3), (2, 64), (3, 65), (14, 700), (21, 90), (28, 66), (35, 2)) for _ in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string"
                          ).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("recipe_flat", "recipe_param_violations"):
        ok, note = compare(spark, con, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name])
        assert ok, note
    got = {r["recipe_id"]: r["errors"] for r in entry.queries()["recipe_errors"](spark, str(tmp_path)).collect()}
    want = dict(con.execute(entry.oracle_sql()["recipe_errors"]).fetchall())
    assert got == {i: "size" if i in (3, 14, 21, 28) else e for i, e in want.items()}
    kept = {r["recipe_id"] for r in entry.queries()["recipe_effective"](spark, str(tmp_path)).collect()}
    assert kept == {i for i, e in got.items() if not e}


def test_recipes_are_gathered_once_and_chains_checked_alike(spark):
    from shootlake.plans import fixtures as fx
    made = fx.recipes(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    rng = random.Random(5)
    kinds = ["exposure", "film", "blend", "crop", "rotate", "optics", "node", "mystery"]
    rows = []
    for i in range(300):
        nodes = []
        for k in range(1, rng.randrange(1, 7)):
            kind = rng.choice(kinds)
            up = k - 1 if rng.random() < .9 else rng.randrange(0, 7)
            params = {rng.choice(["exposure", "left", "quarter_turns", "bogus"]): rng.choice([0.0, 0.5, 9.0])} if rng.random() < .3 else {}
            nodes.append((k if rng.random() < .97 else 1, kind, params, {}, None, rng.choice([0.5, 2.0]), [up, rng.choice([0, 0, 0, 1])] if kind == "blend" else [up],
                          rng.random() < .2, None))
        rows.append((i, nodes, rng.choice([len(nodes), len(nodes), 0, 9])))
    df = spark.createDataFrame(rows, f"i int, recipe {tables.RECIPE}, recipe_output int")
    nodes, output = F.col("recipe"), F.col("recipe_output")
    got = df.select(recipes.errors(nodes, output).alias("a"), recipes._graph_errors(nodes, output).alias("b"), recipes._is_chain(nodes).alias("chain")).collect()
    assert all(r["a"] == r["b"] for r in got) and 50 < sum(r["chain"] for r in got) < 250
    sound = df.where(F.size(recipes.errors(nodes, output)) == 0)
    for after in (F.lit(1), output):
        tried = F.filter(F.array(*[F.lit(k) for k in recipes.R.KINDS]), lambda k: recipes.settled(recipes.insert_after(after, k)(nodes, output)).isNotNull())
        got = sound.select(recipes.insertable(nodes, output, after).alias("a"), tried.alias("b")).collect()
        assert len(got) > 10 and all(r["a"] == r["b"] for r in got)


def test_nodes_are_ordered_steadily(spark):
    rng = random.Random(6)
    rows, want = [], []
    for i in range(200):
        ids = rng.sample(range(1, 9), rng.randrange(1, 7))
        wired = [(n, [rng.choice([0, *ids]) if rng.random() < .3 else rng.choice([0, *ids[:k]])]) for k, n in enumerate(ids)]
        rng.shuffle(wired)
        rest, placed = list(wired), [0]
        while ready := next((w for w in rest if all(v in placed for v in w[1])), None):
            rest.remove(ready)
            placed.append(ready[0])
        want.append((i, None if rest else placed[1:]))
        rows.append((i, [(n, "exposure", {"exposure": float(n)}, {}, None, 1.0, ins, False, None) for n, ins in wired], ids[0]))
    df = spark.createDataFrame(rows, f"i int, recipe {tables.RECIPE}, recipe_output int")
    e = recipes.normalised(F.col("recipe"), F.col("recipe_output"))
    got = df.select("i", F.transform(e["nodes"], lambda n: F.element_at(n["params"], "exposure").cast("int")).alias("o"),
                    F.transform(e["nodes"], lambda n: n["id"]).alias("ids"), e["output"].alias("out")).collect()
    assert sorted((r["i"], r["o"]) for r in got) == want
    assert all(r["o"] is None or r["ids"] == list(range(1, len(r["o"]) + 1)) and r["o"][r["out"] - 1] == rows[r["i"]][2] for r in got)
