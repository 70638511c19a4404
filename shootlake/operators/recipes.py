"""Recipe graphs: checking, pruning and editing the node array of one photo row.

A recipe holds at most 64 nodes and lives in one column, so every operator is a fold over a short
array inside a projection: no recipe operator shuffles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.functions import recipe_kinds as R
from shootlake.functions.binding import let
from shootlake.sources.tables import NODE, RECIPE

EDITED = f"struct<nodes:{RECIPE},output:int>"


def _int(v: int) -> Column:
    return F.lit(v).cast("int")


def _ints() -> Column:
    return F.expr("cast(array() as array<int>)")


def _no_nodes() -> Column:
    return F.expr(f"cast(array() as {RECIPE})")


def node(kind: str | Column, inputs: Column, params: Column | None = None, opacity: Column | float = 1.0,
         node_id: Column | int = 0) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        c(node_id).alias("id"), c(kind).alias("kind"),
        (params if params is not None else F.expr("cast(map() as map<string,double>)")).alias("params"),
        F.expr("cast(map() as map<string,array<double>>)").alias("points"), F.lit(None).cast("string").alias("lut"),
        c(opacity).cast("double").alias("opacity"), inputs.alias("inputs"), F.lit(False).alias("bypassed"),
        F.lit(None).alias("kind_states")).cast(NODE)


def _ascending(points: Column, strict: bool) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.floor(F.size(points) / 2).cast("int") - 1, F.lit(1)))
    gap = lambda i: F.get(points, i * 2) - F.get(points, i * 2 - 2)
    return F.forall(at, lambda i: F.coalesce(gap(i) > R.CURVE_STEP if strict else gap(i) >= R.CURVE_STEP - 1e-9, F.lit(False)))


def points_ok(points: Column, strict: bool = True) -> Column:
    """2 to 16 points within 0..1 whose positions ascend by more than a thousandth."""
    lo, hi = R.CURVE_POINTS
    return (F.size(points) % 2 == 0) & F.size(points).between(2 * lo, 2 * hi) & F.forall(points, lambda v: v.between(0, 1)) & _ascending(points, strict)


def param_problems(n: Column, render: bool = False) -> Column:
    """Keys of a node that do not belong to its kind or lie outside their range, as an array."""
    table = F.create_map(*[x for k, (lo, hi) in R.ranges(render).items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    limits = lambda k: F.element_at(table, F.concat(n["kind"], F.lit("."), k))
    zero_ok = F.lit(render) & (n["kind"] == "white_balance")
    keys = F.transform(F.filter(F.map_entries(n["params"]), lambda e: ~F.coalesce(
        e["value"].between(limits(e["key"])["lo"], limits(e["key"])["hi"])
        | (zero_ok & (e["key"] == "white_balance_temperature") & (e["value"] == 0)), F.lit(False))), lambda e: e["key"])
    p = lambda k: F.coalesce(F.element_at(n["params"], k), F.lit(R.GRAPH_DEFAULTS["crop"][k]))
    spill = (n["kind"] == "crop") & ((p("left") + p("width") > R.CROP_SLACK) | (p("top") + p("height") > R.CROP_SLACK))
    part = (n["kind"] == "rotate") & (F.element_at(n["params"], "quarter_turns") % 1 != 0)
    curves = F.transform(F.filter(F.map_entries(n["points"]), lambda e: (n["kind"] != "curves") | ~e["key"].isin(R.CURVE_CHANNELS)
                                  | ~points_ok(e["value"], not render)), lambda e: e["key"])
    own = F.array_compact(F.array(F.when(spill, F.lit("rectangle")), F.when(F.coalesce(part, F.lit(False)), F.lit("quarter_turns"))))
    return F.concat(keys, curves, own)


def _params_bad(n: Column) -> Column:
    """Does a node have any of `param_problems` (of a project file)? Each parameter's range is looked up once."""
    by_kind: dict[str, list[Column]] = {}
    for name, (lo, hi) in R.ranges(False).items():
        kind, key = name.split(".")
        by_kind.setdefault(kind, []).extend((F.lit(key), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))))
    table = F.create_map(*[x for kind, pairs in by_kind.items() for x in (F.lit(kind), F.create_map(*pairs))])
    outside = lambda v, r: ~F.coalesce(v.between(r["lo"], r["hi"]), F.lit(False))
    # `exists` over one value binds it without copying, as `let` would
    strays = F.exists(F.array(F.element_at(table, n["kind"])), lambda t: F.exists(F.map_entries(n["params"]), lambda e: F.exists(
        F.array(F.element_at(t, e["key"])), lambda r: outside(e["value"], r))))
    shaped = n["kind"].isin("crop", "rotate") | (F.size(n["points"]) > 0)
    held = n["params"].isNotNull() & n["points"].isNotNull()
    return F.coalesce(held & (((F.size(n["params"]) > 0) & strays) | (shaped & (F.size(param_problems(n)) > 0))), F.lit(False))


def _is_chain(nodes: Column) -> Column:
    """Ids 1, 2, 3 and so on, each node reading the one above it, a blend also the source."""
    def linked(n: Column, i: Column) -> Column:
        arity = F.when(n["kind"] == "blend", 2).otherwise(1)
        return F.coalesce(n["kind"].isNotNull() & (n["id"] == i + 1) & (F.size(n["inputs"]) == arity) & (F.get(n["inputs"], F.lit(0)) == i)
                          & ((arity == 1) | (F.get(n["inputs"], F.lit(1)) == R.SOURCE)), F.lit(False))
    return ~F.array_contains(F.transform(nodes, linked), False)


def _chain_errors(nodes: Column, output: Column) -> Column:
    """`errors` of a chain: what lies above a node is one flag for film output and one for reframing."""
    start = F.struct(F.lit(False).alias("display"), F.lit(False).alias("moved"), F.expr("cast(array() as array<string>)").alias("errors"))

    def step(s: Column, n: Column) -> Column:
        kind, live = n["kind"], ~n["bypassed"]
        blend = kind == "blend"
        rules = [(~kind.isin([*R.KINDS, R.UNTYPED]), "kind"), (blend & ~F.coalesce(n["opacity"].between(0, 1), F.lit(False)), "opacity"),
                 (_params_bad(n), "params"), (s["display"] & ~kind.isin(R.READS_DISPLAY), "domain"),
                 (s["moved"] & live & (kind == "optics"), "optics"), (s["moved"] & live & blend, "geometry")]
        wrong = functools.reduce(lambda a, b: a | b, [rule for rule, _ in rules])
        found = F.array_compact(F.array(*[F.when(rule, F.lit(word)) for rule, word in rules]))
        return F.struct(((kind == "film") | (s["display"] & kind.isin(R.KEEPS_DOMAIN))).alias("display"),
                        (s["moved"] | F.coalesce(live & kind.isin(R.REFRAMES), F.lit(False))).alias("moved"),
                        F.when(wrong, F.concat(s["errors"], found)).otherwise(s["errors"]).alias("errors"))

    lost = F.when(~F.coalesce(output.between(0, F.size(nodes)), F.lit(False)), F.array(F.lit("output"))).otherwise(
        F.expr("cast(array() as array<string>)"))
    return F.concat(F.aggregate(nodes, start, step, lambda s: s["errors"]), lost)


def violations(recipes: DataFrame, key: str, render: bool = True) -> DataFrame:
    """(key, node, setting) for each bad parameter of each node."""
    nodes = recipes.select(key, F.explode("recipe").alias("n"))
    return nodes.select(key, F.col("n.id").alias("node"), F.explode(param_problems(F.col("n"), render)).alias("setting"))


def errors(nodes: Column, output: Column) -> Column:
    """Everything wrong with a recipe, as an array of words; empty when it is well formed.

    Ids ascend, inputs lie upstream, arity and parameters fit the kind, only film, crop, rotate and
    untyped nodes read film output, live optics do not follow a crop or turn, a live blend's branches
    were reframed alike, and the output exists. Plain chains, as settings give them, are told beforehand and
    need no record of every node above.
    """
    many = F.when(F.size(nodes) > R.MAX_NODES, F.array(F.lit("size"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(F.when(_is_chain(nodes), _chain_errors(nodes, output)).otherwise(_graph_errors(nodes, output)), many)


def _graph_errors(nodes: Column, output: Column) -> Column:
    start = F.struct(F.array(_int(R.SOURCE)).alias("seen"), _ints().alias("display"),
                     F.create_map(_int(R.SOURCE), F.lit("")).alias("moved"), F.expr("cast(array() as array<string>)").alias("errors"))

    def step(s: Column, n: Column) -> Column:
        kind, inputs, first = n["kind"], n["inputs"], F.get(n["inputs"], F.lit(0))
        blend, live = kind == "blend", ~n["bypassed"]
        history = lambda i: F.coalesce(F.element_at(s["moved"], i), F.lit(""))
        p = lambda k, d: F.coalesce(F.element_at(n["params"], k), F.lit(d)).cast("string")
        shows = F.exists(inputs, lambda i: F.array_contains(s["display"], i))
        move = F.when(kind == "rotate", F.concat(F.lit("r"), p("quarter_turns", 0.0))).otherwise(F.concat_ws(
            ",", *[p(k, R.GRAPH_DEFAULTS["crop"][k]) for k in ("left", "top", "width", "height", "angle")]))
        after = F.when(live & kind.isin(R.REFRAMES), F.concat(history(first), F.lit(";"), move)).otherwise(history(first))
        found = F.array_compact(F.array(
            F.when(n["id"] <= F.element_at(s["seen"], -1), F.lit("order")),
            F.when(F.exists(inputs, lambda i: ~F.array_contains(s["seen"], i)), F.lit("upstream")),
            F.when(~kind.isin([*R.KINDS, R.UNTYPED]), F.lit("kind")),
            F.when(F.size(inputs) != F.when(blend, 2).otherwise(1), F.lit("arity")),
            F.when(blend & ~F.coalesce(n["opacity"].between(0, 1), F.lit(False)), F.lit("opacity")),
            F.when(_params_bad(n), F.lit("params")),
            F.when(shows & ~kind.isin(R.READS_DISPLAY), F.lit("domain")),
            F.when((kind == "optics") & live & (history(first) != ""), F.lit("optics")),
            F.when(blend & live & (history(first) != history(F.get(inputs, F.lit(1)))), F.lit("geometry"))))
        fresh = n["id"] > F.element_at(s["seen"], -1)  # a repeated id never stands in for the node it repeats
        keeps = fresh & ((kind == "film") | (kind.isin(R.KEEPS_DOMAIN) & F.coalesce(F.array_contains(s["display"], first), F.lit(False))))
        return F.struct(
            F.array_append(s["seen"], n["id"]).alias("seen"),
            F.when(keeps, F.array_append(s["display"], n["id"])).otherwise(s["display"]).alias("display"),
            F.when(fresh, F.map_concat(s["moved"], F.create_map(n["id"], after))).otherwise(s["moved"]).alias("moved"),
            F.concat(s["errors"], found).alias("errors"))

    lost = lambda s: F.when(~F.coalesce(F.array_contains(s["seen"], output), F.lit(False)), F.array(F.lit("output"))).otherwise(
        F.expr("cast(array() as array<string>)"))
    return F.aggregate(nodes, start, step, lambda s: F.concat(s["errors"], lost(s)))


def effective(nodes: Column, output: Column) -> Column:
    """`nodes` and `output` of a well-formed recipe without bypassed, untyped and unreachable nodes."""
    start = F.struct(F.create_map(_int(0), _int(0)).alias("to"), _no_nodes().alias("kept"))

    def forward(s: Column, n: Column) -> Column:
        inputs = F.transform(n["inputs"], lambda i: F.element_at(s["to"], i))
        skip = n["bypassed"] | (n["kind"] == R.UNTYPED)
        return F.struct(F.map_concat(s["to"], F.create_map(n["id"], F.when(skip, inputs[0]).otherwise(n["id"]))).alias("to"),
                        F.when(skip, s["kept"]).otherwise(F.array_append(s["kept"], n.withField("inputs", inputs))).alias("kept"))

    def reach(s: Column) -> Column:
        out = F.element_at(s["to"], output)
        begin = F.struct(F.array(out).alias("need"), _no_nodes().alias("nodes"))

        def back(t: Column, n: Column) -> Column:
            needed = F.array_contains(t["need"], n["id"])
            return F.struct(F.when(needed, F.array_union(t["need"], n["inputs"])).otherwise(t["need"]).alias("need"),
                            F.when(needed, F.concat(F.array(n), t["nodes"])).otherwise(t["nodes"]).alias("nodes"))

        return F.struct(F.aggregate(F.reverse(s["kept"]), begin, back, lambda t: t["nodes"]).alias("nodes"), out.alias("output")).cast(EDITED)

    return let(F.aggregate(nodes, start, forward), reach)


def normalised(nodes: Column, output: Column) -> Column:
    """Topological order, steady by listing, renumbered 1..n; null when the wiring has a cycle.

    Recipes numbered in order stay as they are. Else a pass places nodes as listed and ends where a node that had to wait becomes ready, which comes next then; a
    recipe already in order takes one pass.
    """
    start = F.struct(nodes.alias("rest"), F.array(_int(0)).alias("placed"), _no_nodes().alias("done"), F.lit(False).alias("turn"))

    def ready(n: Column, placed: Column) -> Column:
        return F.forall(n["inputs"], lambda i: F.array_contains(placed, i))

    def walk(s: Column) -> Column:
        begin = F.struct(_no_nodes().alias("rest"), s["placed"].alias("placed"), s["done"].alias("done"), F.lit(False).alias("turn"))

        def place(t: Column, n: Column) -> Column:
            def put(placed: Column) -> Column:
                return F.struct(t["rest"].alias("rest"), placed.alias("placed"), F.array_append(t["done"], n).alias("done"),
                                F.exists(t["rest"], lambda w: F.coalesce(ready(w, placed), F.lit(False))).alias("turn"))
            waits = F.struct(F.array_append(t["rest"], n).alias("rest"), t["placed"].alias("placed"), t["done"].alias("done"), t["turn"].alias("turn"))
            again = (n["id"] != 0) & F.array_contains(t["placed"], n["id"])  # a repeated id never stands in for the node it repeats
            return F.when(again, t).when(~t["turn"] & F.coalesce(ready(n, t["placed"]), F.lit(False)), let(F.array_append(t["placed"], n["id"]), put)).otherwise(waits)
        return F.aggregate(s["rest"], begin, place)

    def number(s: Column) -> Column:
        ids = F.map_from_entries(F.concat(F.array(F.struct(_int(0).alias("k"), _int(0).alias("v"))), F.transform(
            s["done"], lambda n, i: F.struct(n["id"].alias("k"), (i + 1).alias("v")))))
        return let(ids, lambda m: F.struct(F.transform(s["done"], lambda n: n.withField("id", F.element_at(m, n["id"])).withField(
            "inputs", F.transform(n["inputs"], lambda i: F.element_at(m, i))).withField("kind_states", F.transform(
                n["kind_states"], lambda k: k.withField("second_input", F.when(k["second_input"].isNotNull(), F.coalesce(
                    F.element_at(m, k["second_input"]), _int(0))))))).alias("nodes"), F.element_at(m, output).alias("output")).cast(EDITED))

    walked = F.aggregate(F.sequence(F.lit(1), F.size(nodes)), start, lambda s, _: F.when(F.size(s["rest"]) == 0, s).otherwise(walk(s)))
    def kept(n: Column, i: Column) -> Column:
        states = F.forall(n["kind_states"], lambda k: k["second_input"].isNull() | k["second_input"].between(0, F.size(nodes)))
        return F.coalesce((n["id"] == i + 1) & F.forall(n["inputs"], lambda v: v.between(0, i)) & (n["kind_states"].isNull() | states), F.lit(False))

    as_is = F.struct(nodes.alias("nodes"), F.when(output.between(0, F.size(nodes)) | (F.size(nodes) == 0), output).alias("output")).cast(EDITED)
    return F.when(~F.array_contains(F.transform(nodes, kept), False), as_is).otherwise(
        let(walked, lambda s: F.when(F.size(s["rest"]) == 0, number(s))))


def settled(edited: Column) -> Column:
    """The edited recipe in order and renumbered, or null when it is not well formed."""
    tidy = F.when(edited.isNotNull(), normalised(edited["nodes"], edited["output"]))
    return let(tidy, lambda e: F.when(e["output"].isNotNull() & (F.size(errors(e["nodes"], e["output"])) == 0), e))


def edit(recipes: DataFrame, change: Callable[[Column, Column], Column]) -> DataFrame:
    """Apply `change(nodes, output)` and keep it only where the outcome is well formed.

    `change` returns an `EDITED` struct or null. Adds `applied`; rows where it is false are untouched.
    """
    staged = recipes.withColumn("_e", let(change(F.col("recipe"), F.col("recipe_output")), settled))
    return staged.withColumns({"applied": F.col("_e").isNotNull(), "recipe": F.coalesce("_e.nodes", "recipe"),
                               "recipe_output": F.coalesce("_e.output", "recipe_output")}).drop("_e")


def _edited(nodes: Column, output: Column) -> Column:
    return F.struct(nodes.alias("nodes"), output.cast("int").alias("output")).cast(EDITED)


def find(nodes: Column, node_id: Column) -> Column:
    return F.get(F.filter(nodes, lambda n: n["id"] == node_id), F.lit(0))


def consumers(nodes: Column, node_id: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: F.array_contains(n["inputs"], node_id)), lambda n: n["id"])


def _read(nodes: Column, old: Column, new: Column, but: Column | None = None) -> Column:
    """Every reader of `old` (but one) reads `new` instead."""
    def one(n: Column) -> Column:
        swapped = n.withField("inputs", F.transform(n["inputs"], lambda i: F.when(i == old, new).otherwise(i)))
        return swapped if but is None else F.when(n["id"] == but, n).otherwise(swapped)
    return F.transform(nodes, one)


def _with(nodes: Column, node_id: Column, change: Callable[[Column], Column]) -> Column:
    return F.transform(nodes, lambda n: F.when(n["id"] == node_id, change(n)).otherwise(n))


def _exists(nodes: Column, node_id: Column) -> Column:
    return (node_id == 0) | F.exists(nodes, lambda n: n["id"] == node_id)


def insert_after(after: Column, kind: str | Column, params: Column | None = None, opacity: float = 0.5,
                 second: Column | None = None) -> Callable[[Column, Column], Column]:
    """A new node reading `after`; whatever read `after`, the output included, reads the new node."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)

    def change(nodes: Column, output: Column) -> Column:
        new = F.greatest(F.coalesce(F.array_max(F.transform(nodes, lambda n: n["id"])), _int(0)), _int(0)) + 1
        blend = kind == "blend"
        inputs = F.when(blend, F.array(after.cast("int"), second.cast("int") if second is not None else _int(0))).otherwise(F.array(after.cast("int")))
        added = node(kind, inputs, params, F.when(blend, F.lit(opacity)).otherwise(F.lit(1.0)), new)
        read = _read(nodes, after, new)
        # in a chain all that follows reads the new node, so it is listed in its place there
        listed = F.when(_is_chain(nodes), F.concat(F.slice(read, 1, after), F.array(added), F.slice(read, after + 1, F.size(nodes)))).otherwise(
            F.array_append(read, added))
        return F.when(_exists(nodes, after), _edited(listed,
                                                     F.when(output == after, new).otherwise(output)))
    return change


def delete(node_id: Column) -> Callable[[Column, Column], Column]:
    """Readers of the node, and blends remembered by retyped nodes, read its first input."""
    def change(nodes: Column, output: Column) -> Column:
        def gone(up: Column) -> Column:
            rest = F.filter(_read(nodes, node_id, up), lambda n: n["id"] != node_id)
            rest = F.transform(rest, lambda n: n.withField("kind_states", F.transform(n["kind_states"], lambda k: k.withField(
                "second_input", F.when(k["second_input"] == node_id, up).otherwise(k["second_input"])))))
            return _edited(rest, F.when(output == node_id, up).otherwise(output))
        return let(find(nodes, node_id)["inputs"][0], lambda up: F.when(up.isNotNull(), gone(up)))
    return change


def swap_with_upstream(node_id: Column) -> Callable[[Column, Column], Column]:
    """Exchange a plain filter with the plain filter above it, when nothing else reads that one."""
    def change(nodes: Column, output: Column) -> Column:
        def exchanged(pair: Column) -> Column:
            me, up = pair["me"], pair["up"]
            plain = lambda n: ~n["kind"].isin("blend", "film")
            ok = me.isNotNull() & up.isNotNull() & plain(me) & plain(up) & (F.size(consumers(nodes, up["id"])) == 1)
            rest = F.filter(_read(nodes, me["id"], up["id"]), lambda n: n["id"] != me["id"])
            moved = F.flatten(F.transform(rest, lambda n: F.when(n["id"] == up["id"], F.array(
                me.withField("inputs", F.array(up["inputs"][0])), n.withField("inputs", F.array(me["id"])))).otherwise(F.array(n))))
            return F.when(ok, _edited(moved, F.when(output == me["id"], up["id"]).otherwise(output)))
        me = find(nodes, node_id)
        return let(F.struct(me.alias("me"), find(nodes, me["inputs"][0]).alias("up")), exchanged)
    return change


def move_after(node_id: Column, after: Column) -> Callable[[Column, Column], Column]:
    """Take a node out of its chain and put it after another; null when it is already there."""
    def change(nodes: Column, output: Column) -> Column:
        def moved(me: Column) -> Column:
            up = me["inputs"][0]
            out = F.when(output == node_id, up).otherwise(output)
            spliced = _read(_read(nodes, node_id, up), after, node_id, but=node_id)
            placed = _with(spliced, node_id, lambda n: n.withField("inputs", F.concat(
                F.array(after.cast("int")), F.slice(me["inputs"], 2, 1))))
            return F.when(me.isNotNull() & _exists(nodes, after) & (node_id != after) & (up != after),
                          _edited(placed, F.when(out == after, node_id).otherwise(out)))
        return let(find(nodes, node_id), moved)
    return change


def rewire(node_id: Column, source: Column, branch: int = 0) -> Callable[[Column, Column], Column]:
    """Point a node's primary input (branch 0), or a blend's second (branch 1), at another node."""
    def change(nodes: Column, output: Column) -> Column:
        def wired(me: Column) -> Column:
            other = F.concat(F.array(source.cast("int")), F.slice(me["inputs"], 2, 1)) if branch == 0 else F.array(me["inputs"][0], source.cast("int"))
            fits = me.isNotNull() & _exists(nodes, source) & (source != node_id) & (F.get(me["inputs"], F.lit(branch)) != source)
            if branch:
                fits = fits & (me["kind"] == "blend")
            return F.when(fits, _edited(_with(nodes, node_id, lambda n: n.withField("inputs", other)), output))
        return let(find(nodes, node_id), wired)
    return change


def set_output(node_id: Column) -> Callable[[Column, Column], Column]:
    return lambda nodes, output: F.when(F.exists(nodes, lambda n: n["id"] == node_id) & (output != node_id), _edited(nodes, node_id))


def retype(node_id: Column, kind: str) -> Callable[[Column, Column], Column]:
    """Change a node's kind; each kind's parameters, and a blend's mix, wait for its return."""
    def change(nodes: Column, output: Column) -> Column:
        def turned(n: Column) -> Column:
            was_blend = n["kind"] == "blend"
            kept = F.struct(n["kind"].alias("kind"), n["params"].alias("params"), F.when(was_blend, n["opacity"]).alias("opacity"),
                            F.when(was_blend, F.get(n["inputs"], F.lit(1))).alias("second_input"))
            others = F.filter(F.coalesce(n["kind_states"], F.expr(
                "cast(array() as array<struct<kind:string,params:map<string,double>,opacity:double,second_input:int>>)")),
                lambda k: k["kind"] != n["kind"])
            state = F.get(F.filter(others, lambda k: k["kind"] == kind), F.lit(0))
            second = F.when((state["second_input"] < n["id"]) & _exists(nodes, state["second_input"]), state["second_input"]).otherwise(_int(0))
            inputs = F.array(n["inputs"][0], F.coalesce(second, _int(0))) if kind == "blend" else F.array(n["inputs"][0])
            return (n.withField("kind", F.lit(kind)).withField("inputs", inputs)
                    .withField("params", F.coalesce(state["params"], F.expr("cast(map() as map<string,double>)")))
                    .withField("opacity", F.coalesce(state["opacity"], F.lit(0.5)) if kind == "blend" else F.lit(1.0))
                    .withField("points", F.expr("cast(map() as map<string,array<double>>)"))
                    .withField("kind_states", F.concat(F.array(kept), others)))
        known = kind in R.KINDS or kind == R.UNTYPED
        fits = F.lit(known) & F.exists(nodes, lambda n: (n["id"] == node_id) & (n["kind"] != kind))
        return F.when(fits, _edited(_with(nodes, node_id, turned), output))
    return change


def without_kinds(nodes: Column, kinds: list[str]) -> Column:
    return F.transform(nodes, lambda n: n.withField("bypassed", n["bypassed"] | n["kind"].isin(kinds)))


def in_display(nodes: Column) -> Column:
    """Ids of the nodes whose branch has passed through film."""
    return F.aggregate(nodes, _ints(), lambda seen, n: F.when(
        (n["kind"] == "film") | (n["kind"].isin(R.KEEPS_DOMAIN) & F.coalesce(F.array_contains(seen, n["inputs"][0]), F.lit(False))),
        F.array_append(seen, n["id"])).otherwise(seen))


def _climb(nodes: Column, start: Column, on: Callable[[Column], Column]) -> Column:
    """From `start` follow first inputs upstream while `on(node)`; nodes come after their inputs, so
    one pass over the reversed array suffices."""
    return F.aggregate(F.reverse(nodes), start.cast("int"), lambda at, n: F.when((n["id"] == at) & on(n), n["inputs"][0]).otherwise(at))


def insertion_point(nodes: Column, after: Column, kind: str) -> Column:
    """The furthest position at or above `after` where the kind may read."""
    if kind in R.READS_DISPLAY:
        return after
    return let(in_display(nodes), lambda shown: _climb(nodes, after, lambda n: F.array_contains(shown, n["id"])))


def tail_linear(nodes: Column, output: Column) -> Column:
    """The last node on the output path before the film tail."""
    return _climb(nodes, output, lambda n: n["kind"] == "film")


def last_covering(nodes: Column, stage: str) -> Column:
    """The furthest downstream node of a stage, or null."""
    return F.get(
        F.reverse(F.transform(F.filter(nodes, lambda n: n["kind"] == stage), lambda n: n["id"])), F.lit(0))


def insertable(nodes: Column, output: Column, after: Column) -> Column:
    """Kinds that may be inserted after a node, in menu order: each is tried and checked like any edit.

    The order of the nodes is the same for every kind, so it is settled once, with a stand-in. Kinds that no rule
    of wiring tells apart are tried as one.
    """
    menu = F.array(*[F.lit(k) for k in R.KINDS])
    alike = [k for k in R.KINDS if k not in R.TOLD_APART]
    tried = F.array(*[F.lit(k) for k in [*R.TOLD_APART, alike[0]]])

    def fits(e: Column, kind: Column) -> Column:
        def turned(n: Column) -> Column:
            inputs = F.when(kind == "blend", F.array(n["inputs"][0], _int(R.SOURCE))).otherwise(n["inputs"])
            return n.withField("kind", kind).withField("inputs", inputs).withField("opacity", F.when(kind == "blend", 0.5).otherwise(1.0))
        made = F.transform(e["nodes"], lambda n: F.when(n["kind"] == R.STAND_IN, turned(n)).otherwise(n))
        return let(made, lambda m: F.size(errors(m, e["output"])) == 0)

    def kinds(e: Column) -> Column:
        return let(F.filter(tried, lambda k: fits(e, k)), lambda ok: F.filter(menu, lambda k: F.array_contains(ok, k) | (
            ~k.isin(R.TOLD_APART) & F.array_contains(ok, alike[0]))))

    own = F.exists(nodes, lambda n: n["kind"] == R.STAND_IN)
    staged = let(F.when(~F.coalesce(own, F.lit(False)), insert_after(after, R.STAND_IN)(nodes, output)),
                 lambda e: F.when(e.isNotNull(), normalised(e["nodes"], e["output"])))
    return let(staged, lambda e: F.when(e["output"].isNotNull(), kinds(e)).otherwise(F.expr("cast(array() as array<string>)")))


def active_optics(nodes: Column, output: Column) -> Column:
    """Does the effective recipe apply any lens correction?"""
    return F.exists(effective(nodes, output)["nodes"], lambda n: (n["kind"] == "optics") & (
        (F.coalesce(F.element_at(n["params"], "lens_correction"), F.lit(0.0)) != 0)
        | (F.coalesce(F.element_at(n["params"], "chromatic_aberration_correction"), F.lit(0.0)) != 0)))


def packed(n: Column) -> Column:
    """A node's parameters in their fixed order, gaps filled with the kind's defaults."""
    from shootlake.functions.settings_keys import STAGES, TEXTS
    out = F.when(n["kind"] == "blend", F.array(n["opacity"]))
    get = lambda k, d: F.coalesce(F.element_at(n["params"], k), F.lit(d))
    for kind, keys in R.GRAPH_DEFAULTS.items():
        out = out.when(n["kind"] == kind, F.array(*[get(k, d) for k, d in keys.items()]))
    for stage, keys in STAGES.items():
        values = [get(k, R.STAGE_DEFAULTS.get(k, 0.0)) for k in keys if k not in TEXTS]
        if stage == "film":
            values[0] = F.when(n["lut"].isNull(), F.lit(0.0)).otherwise(values[0])
        out = out.when(n["kind"] == stage, F.array(*values))
    points = F.transform(F.array(*[F.lit(c) for c in R.CURVE_CHANNELS]), lambda c: F.coalesce(
        F.element_at(n["points"], c), F.array(*[F.lit(v) for v in R.IDENTITY_CURVE])))
    return out.when(n["kind"] == "curves", F.concat(F.transform(points, lambda p: F.floor(F.size(p) / 2).cast("double")), F.flatten(points)))


def grain_ordinals(nodes: Column) -> Column:
    """Ids of the grainy film nodes in execution order; a node's index is its grain ordinal."""
    return F.transform(F.filter(nodes, lambda n: (n["kind"] == "film") & (F.coalesce(F.element_at(n["params"], "grain_amount"), F.lit(0.0)) > 0)),
                       lambda n: n["id"])
