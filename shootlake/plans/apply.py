"""Applying recipes to pixels: one plan per recipe skeleton.

A recipe is cut at the nodes that need neighbours, other places or a second set of pixels: filters, crops, turns, lens maps, and
blends of branches that such nodes lie between. These and their wiring are its skeleton. What lies between is a run of point
nodes, and runs are data: photos of one skeleton share one plan, whatever their point nodes and parameters. A run joins all its
parameters once; its steps are projections, conditional on each photo's own node where photos differ. A blend of two branches
that only point nodes have come between carries two colour triples through the same projection, so it joins no pixels.

Point nodes do not depend on where a pixel lies (film grain does, but only of upright frames), so turning a frame upright moves
ahead of the run whose nodes ask for it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shootlake.functions import bits
from shootlake.functions import recipe_kinds as R
from shootlake.operators import filters, geometry, grading, measure
from shootlake.operators import recipes as RE
from shootlake.operators import settings as S
from shootlake.session import ensure_checkpoint_dir

# Kinds whose result depends on the frame being upright already.
UPRIGHT_FIRST = {"noise_reduction", "contrast", "sharpen", "tone", "film", "color_subtract", "crop", "rotate", "curves"}
#: Kinds that need more than a pixel and its parameters.
HARD = {"noise_reduction", "sharpen", "crop", "rotate", "optics"}


@dataclass(frozen=True)
class Branch:
    """Pixels at one point of a recipe, the size of their frames, and whether these stand upright."""

    px: DataFrame
    frames: DataFrame
    upright: bool = False


def prepared(recipes: DataFrame) -> DataFrame:
    """(image_id, shape, nodes): effective nodes with packed parameters, and the shape as JSON text.

    `recipes` has (image_id, recipe, recipe_output), well formed.
    """
    eff = recipes.withColumn("_e", RE.effective(F.col("recipe"), F.col("recipe_output")))
    grainy = RE.grain_ordinals(F.col("_e.nodes"))
    nodes = F.transform("_e.nodes", lambda n: F.struct(
        n["id"].alias("id"), n["kind"].alias("kind"), RE.packed(n).alias("p"), n["points"].alias("points"), n["lut"].alias("lut_id"),
        F.greatest(F.array_position(grainy, n["id"]) - 1, F.lit(0)).alias("ordinal")))
    shape = F.to_json(F.struct(F.transform("_e.nodes", lambda n: F.struct(
        n["id"].alias("id"), n["kind"].alias("kind"), n["inputs"].alias("inputs"))).alias("nodes"), F.col("_e.output").alias("output")))
    return eff.select("image_id", shape.alias("shape"), nodes.alias("nodes"))


def _upright(b: Branch) -> Branch:
    if b.upright:
        return b
    turned = F.col("orientation").between(5, 8)
    sizes = b.frames.withColumns({"width": F.when(turned, F.col("height")).otherwise(F.col("width")),
                                  "height": F.when(turned, F.col("width")).otherwise(F.col("height"))})
    return replace(b, px=geometry.orient(b.px, b.frames), frames=sizes, upright=True)


def _held(b: Branch) -> Branch:
    """The branch written to the checkpoint folder: what follows reads these pixels several times, and
    without a cut each reading would repeat every node before it."""
    ensure_checkpoint_dir(b.px.sparkSession)
    return replace(b, px=b.px.checkpoint())


# --- skeletons -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Edge:
    """How a node gets its pixels: from a hard node, a blend or the source (0), through run number `run`."""

    source: int
    upright: bool
    run: int


@dataclass(frozen=True)
class Skeleton:
    """Hard nodes and blends, numbered from 1 in order, with their edges; the last edge is the output's."""

    kinds: tuple[str, ...]
    inputs: tuple[tuple[Edge, ...], ...]
    output: Edge

    @property
    def key(self) -> str:
        flat = lambda e: [e.source, e.upright]
        return json.dumps([list(self.kinds), [[flat(e) for e in ins] for ins in self.inputs], flat(self.output)])

    def base(self, node: int) -> int:
        """The node whose pixels `node` only changes point by point: itself, or for a blend within a run what both branches stem from."""
        if node == 0 or self.kinds[node - 1] != "blend":
            return node
        bases = {self.base(e.source) for e in self.inputs[node - 1]}
        return bases.pop() if len(bases) == 1 else node


#: A step of a run: the kind of point node and the node's id; `display` is the step into display space and has no node.
Step = tuple[str, int]


def skeleton_of(shape: str) -> tuple[Skeleton, list[list[Step]], list[int]]:
    """The skeleton of a shape, the steps of each of its runs, and the ids of its hard nodes and blends."""
    plan = json.loads(shape)
    nodes = {n["id"]: n for n in plan["nodes"]}
    cut = [n["id"] for n in plan["nodes"] if n["kind"] in HARD or n["kind"] == "blend"]
    number = {R.SOURCE: 0, **{i: k for k, i in enumerate(cut, 1)}}
    upright, display, runs = {0: False}, {0: False}, []

    def edge(node: int, asks: bool) -> tuple[Edge, bool]:
        """The edge that ends with `node`, and whether it is in display space."""
        steps: list[Step] = []
        while node not in number:
            steps.insert(0, (nodes[node]["kind"], node))
            node = nodes[node]["inputs"][0]
        at = number[node]
        shown = display[at]
        for k, (kind, _) in enumerate(steps):
            if kind == "film" and not shown:
                steps.insert(k, ("display", 0))
                shown = True
                break
        runs.append(steps)
        return Edge(at, upright[at] or asks or any(k in UPRIGHT_FIRST for k, _ in steps), len(runs) - 1), shown

    inputs = []
    for at, node in enumerate(cut, 1):
        kind = nodes[node]["kind"]
        found = [edge(i, kind in UPRIGHT_FIRST) for i in nodes[node]["inputs"]]
        up = any(e.upright for e, _ in found)
        inputs.append(tuple(replace(e, upright=up) for e, _ in found))
        upright[at], display[at] = up, found[0][1]
    last, shown = edge(plan["output"], True)
    if not shown:
        runs[-1].append(("display", 0))
    # pixels of a blend within a run stand as its consumers ask, so its own branches do too
    skeleton = Skeleton(tuple(nodes[i]["kind"] for i in cut), tuple(inputs), last)
    for at in range(len(cut), 0, -1):
        if skeleton.base(at) != at:
            asked = any(e.source == at and e.upright for e in [last, *[e for ins in inputs for e in ins]])
            inputs[at - 1] = tuple(replace(e, upright=e.upright or asked) for e in inputs[at - 1])
    return replace(skeleton, inputs=tuple(inputs)), runs, cut


@dataclass
class Group:
    """Shapes of one skeleton: per shape its runs and node ids, and per run and step the kinds that occur (None: no step)."""

    skeleton: Skeleton
    shapes: dict[str, tuple[list[list[Step]], list[int]]]

    def steps(self, run: int) -> list[set[str | None]]:
        longest = max(len(runs[run]) for runs, _ in self.shapes.values())
        return [{runs[run][k][0] if k < len(runs[run]) else None for runs, _ in self.shapes.values()} for k in range(longest)]

    def arranged(self, rows: DataFrame) -> DataFrame:
        """(image_id, runs, hards): each photo's nodes by run and step, and those of its hard nodes and blends."""
        ids = lambda runs: F.array(*[F.array(*[F.lit(i) for _, i in run]).cast("array<int>") for run in runs])
        places = F.create_map(*[x for shape, (runs, cut) in self.shapes.items() for x in (F.lit(shape), F.struct(
            ids(runs).alias("runs"), F.array(*[F.lit(i) for i in cut]).cast("array<int>").alias("hards")))])
        kinds = F.create_map(*[x for shape, (runs, _) in self.shapes.items() for x in (
            F.lit(shape), F.array(*[F.array(*[F.lit(k) for k, _ in run]).cast("array<string>") for run in runs]))])
        node = lambda i: F.get(F.filter("nodes", lambda n: n["id"] == i), F.lit(0))
        mine = rows.where(F.col("shape").isin(list(self.shapes))).withColumns({"_at": places[F.col("shape")], "_kinds": kinds[F.col("shape")]})
        return mine.select(
            "image_id", F.zip_with("_at.runs", "_kinds", lambda ids, kinds: F.zip_with(
                ids, kinds, lambda i, k: F.struct(k.alias("kind"), node(i).alias("n")))).alias("runs"),
            F.transform("_at.hards", node).alias("hards"))


def grouped(shapes: Iterator[str]) -> list[Group]:
    groups: dict[str, Group] = {}
    for shape in shapes:
        skeleton, runs, cut = skeleton_of(shape)
        groups.setdefault(skeleton.key, Group(skeleton, {})).shapes[shape] = runs, cut
    return list(groups.values())


# --- runs ----------------------------------------------------------------------------------------

class Run:
    """One run's parameters as columns of a photo's row, and its steps as projections."""

    def __init__(self, number: int, steps: list[set[str | None]], luts: DataFrame | None):
        self.number, self.steps, self.luts = number, steps, luts

    def _c(self, step: int, name: str) -> str:
        return f"_{self.number}_{step}_{name}"

    def widen(self, params: DataFrame) -> tuple[DataFrame, list[str]]:
        """Add the run's columns to (image_id, runs, as_shot_kelvin, grain_seed); their names."""
        made: list[str] = []

        def add(df: DataFrame, step: int, **cols: Column) -> DataFrame:
            made.extend(self._c(step, k) for k in cols)
            return df.withColumns({self._c(step, k): v for k, v in cols.items()})
        for k, kinds in enumerate(self.steps):
            at = F.get(F.get(F.col("runs"), F.lit(self.number)), F.lit(k))
            params = add(params, k, kind=at["kind"], p=at["n"]["p"])
            mine = lambda kind, v, at=at: F.when(at["kind"] == kind, v)
            if "white_balance" in kinds:
                asked = params.withColumns({"kelvin": mine("white_balance", at["n"]["p"][0]), "tint": mine("white_balance", at["n"]["p"][1])})
                names = {f"w{i}{j}": self._c(k, f"w{i}{j}") for i in range(3) for j in range(3)}
                params = grading.white_matrix(asked).drop("kelvin", "tint").withColumnsRenamed(names)
                made.extend(names.values())
            if "curves" in kinds:
                flat = F.array(*[F.lit(v) for v in R.IDENTITY_CURVE])
                params = grading.curve_tables(params, {self._c(k, c): F.coalesce(F.element_at(at["n"]["points"], c), flat) for c in R.CURVE_CHANNELS})
                made.extend(self._c(k, c) for c in R.CURVE_CHANNELS)
            if "film" in kinds:
                seeds = F.array(*[F.lit(bits.signed(n * grading.GRAIN_ORDINAL)).cast("long") for n in range(R.MAX_NODES)])
                params = add(params, k, lut=mine("film", at["n"]["lut_id"]),
                             seed=F.col("grain_seed").bitwiseXOR(F.get(seeds, F.coalesce(at["n"]["ordinal"], F.lit(0)).cast("int"))))
        return params, made

    def apply(self, df: DataFrame) -> DataFrame:
        """r, g, b after the run's steps."""
        for k, kinds in enumerate(self.steps):
            before = df
            several = len(kinds) > 1
            if several:
                df = df.withColumns({f"_o{c}": F.col(c) for c in grading.RGB})
            for kind in sorted(x for x in kinds if x):
                df = self._step(df, k, kind) if not several else self._guarded(df, k, kind)
            if several:
                df = df.select(*before.columns)
        return df

    def _guarded(self, df: DataFrame, k: int, kind: str) -> DataFrame:
        """The step for photos whose node is of this kind; the others keep what they had."""
        kept = df.withColumns({f"_k{c}": F.col(c) for c in grading.RGB}).withColumns({c: F.col(f"_o{c}") for c in grading.RGB})
        mine = F.col(self._c(k, "kind")).eqNullSafe(kind)
        return self._step(kept, k, kind).withColumns({c: F.when(mine, F.col(c)).otherwise(F.col(f"_k{c}")) for c in grading.RGB}).select(*df.columns)

    def _step(self, df: DataFrame, k: int, kind: str) -> DataFrame:
        mine = F.when(F.col(self._c(k, "kind")) == kind, F.col(self._c(k, "p")))
        p = lambda i: F.get(mine, F.lit(i))
        if kind == "exposure":
            return grading.exposure(df, p(0))
        if kind == "white_balance":
            names = [f"w{i}{j}" for i in range(3) for j in range(3)]
            return grading.apply_matrix(df.withColumns({n: F.col(self._c(k, n)) for n in names}))
        if kind == "tone":
            return grading.tone(df, mine)
        if kind == "contrast":
            return grading.contrast(df, p(0), p(1))
        if kind == "color_subtract":
            return grading.color_subtract(df, (p(0), p(1), p(2)))
        if kind == "curves":
            return grading.curves(df, tuple(self._c(k, f"{c}") for c in R.CURVE_CHANNELS[:3]), self._c(k, R.CURVE_CHANNELS[3]))
        if kind == "display":
            return grading.to_display(df)
        if kind == "film":
            lit = df
            if self.luts is not None:
                lit = grading.film_lut(df.withColumn("lut_id", F.col(self._c(k, "lut"))), self.luts, p(0)).drop("lut_id")
            return grading.grain(lit, p(1), p(2), F.col(self._c(k, "seed")))
        raise ValueError(f"unknown node kind {kind}")


# --- plans ---------------------------------------------------------------------------------------

class Plan:
    """Pixels of one group of shapes."""

    def __init__(self, group: Group, source: Branch, rows: DataFrame, luts: DataFrame | None, lens_map: DataFrame | None, tile: int,
                 places: dict[int, DataFrame] | None = None, profiles: DataFrame | None = None):
        """`places` gives the rectangle of each hard node's pixels that are asked for, `profiles` (image_id, node, deviations)
        the noise its filters go by; without them whole frames are made and noise is measured on what the filter gets."""
        self.group, self.skeleton, self.luts, self.lens_map, self.tile = group, group.skeleton, luts, lens_map, tile
        self.rows = group.arranged(rows)
        self.branches = {0: source}
        self.places, self.profiles = places or {}, profiles
        self.measured: list[DataFrame] = []

    def params(self, node: int) -> DataFrame:
        return self.rows.select("image_id", F.col("hards")[node - 1]["p"].alias("p"))

    def _edges(self, edge: Edge, base: int) -> list[Edge]:
        """The edge and those of all blends it takes its pixels through, back to the base."""
        inner = [] if edge.source == base else [x for e in self.skeleton.inputs[edge.source - 1] for x in self._edges(e, base)]
        return [edge, *inner]

    def at(self, edge: Edge) -> Branch:
        """The pixels at the end of an edge: one join of parameters, then projections only."""
        base = self.skeleton.base(edge.source)
        edges = self._edges(edge, base)
        b = self.branches[base]
        if any(e.upright for e in edges):
            b = _upright(b)
        runs = {e.run: Run(e.run, steps, self.luts) for e in edges if (steps := self.group.steps(e.run))}
        blends = [e.source for e in edges if e.source != base]
        if not runs and not blends:
            return b
        params = self.rows.join(b.frames.select("image_id", "as_shot_kelvin", "grain_seed"), "image_id")
        names: list[str] = []
        for run in runs.values():
            params, made = run.widen(params)
            names += made
        shares = [F.col("hards")[n - 1]["p"][0].alias(f"_share{n}") for n in dict.fromkeys(blends)]
        df = b.px.join(params.select("image_id", *names, *shares), "image_id")
        if blends:
            df = df.withColumns({f"_z{c}": F.col(c) for c in grading.RGB})

        def value(df: DataFrame, e: Edge) -> DataFrame:
            if e.source != base:
                first, second = self.skeleton.inputs[e.source - 1]
                df = value(df, first).withColumns({f"_b{e.source}{c}": F.col(c) for c in grading.RGB})
                df, kept = value(df, second), lambda c: F.col(f"_b{e.source}{c}")
                df = df.withColumns({c: kept(c) + (F.col(c) - kept(c)) * F.col(f"_share{e.source}") for c in grading.RGB})
            elif blends:
                df = df.withColumns({c: F.col(f"_z{c}") for c in grading.RGB})
            return runs[e.run].apply(df) if e.run in runs else df
        return replace(b, px=value(df, edge).select("image_id", "y", "x", *grading.RGB))

    def node(self, number: int) -> Branch:
        """The pixels a hard node or a blend of separate branches makes."""
        kind, ins = self.skeleton.kinds[number - 1], self.skeleton.inputs[number - 1]
        params, p = self.params(number), lambda i: F.col("p")[i]
        b = self.at(ins[0])
        if kind == "blend":
            other = self.at(ins[1])
            # branches of unequal size: the photo is refused as a whole, not cut to what both cover
            sizes = other.frames.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
            fits = b.frames.join(sizes, "image_id").where("width = _w AND height = _h").select("image_id")
            mixed = grading.blend(b.px.join(params.join(fits, "image_id"), "image_id"), other.px, p(0))
            return replace(b, px=mixed.select("image_id", "y", "x", *grading.RGB))
        asked = b.frames.join(params, "image_id")
        if kind == "rotate":
            asked = asked.withColumn("_q", p(0).cast("int"))
            swap = F.col("_q") % 2 == 1
            sizes = asked.withColumns({"width": F.when(swap, F.col("height")).otherwise(F.col("width")),
                                       "height": F.when(swap, F.col("width")).otherwise(F.col("height"))}).select(*b.frames.columns)
            return replace(b, px=geometry.rotate(b.px, asked, F.col("_q")), frames=sizes)
        if kind == "optics" and self.lens_map is None:
            return b
        b = _held(b)
        if kind == "optics":
            return replace(b, px=geometry.remap(b.px, self.lens_map, asked, F.when(p(0) != 0, p(1)).otherwise(F.lit(0.0)), self.tile,
                                                self.places.get(number)))
        if kind == "crop":
            windows = geometry.crop_window(asked, p(0), p(1), p(2), p(3)).withColumn("_turned", F.abs(p(4)) >= 0.01)
            straight = geometry.crop(b.px, windows.where("NOT _turned"))
            turned = geometry.crop_turned(b.px, windows.where("_turned"), p(4), self.tile, self.places.get(number))
            sizes = windows.withColumns({"width": F.col("cw"), "height": F.col("ch")}).select(*b.frames.columns)
            return replace(b, px=straight.unionByName(turned.select(*straight.columns)), frames=sizes)
        scale = filters.scale_ratio(F.col("scaled_pixels"), F.col("full_pixels"))
        asked = self._noise(number, b).join(asked.select("image_id", "p", "scaled_pixels", "full_pixels"), "image_id")
        if kind == "noise_reduction":
            return replace(b, px=filters.noise_reduction(b.px, asked.withColumn("strength", filters.scaled_strength(p(0), scale)), self.tile))
        return replace(b, px=filters.sharpen(b.px, asked.withColumns({"amount": p(0), "radius": p(1) * scale, "threshold": p(2)}), self.tile))

    def _noise(self, number: int, b: Branch) -> DataFrame:
        """(image_id, deviations) for a filter: those given, or measured on the pixels it gets."""
        node = self.rows.select("image_id", F.col("hards")[number - 1]["id"].alias("node"))
        if self.profiles is not None:
            return node.join(self.profiles, ["image_id", "node"]).select("image_id", "deviations")
        found = measure.noise_profile(b.px, b.frames, self.tile)
        self.measured.append(found.join(node, "image_id").select("image_id", "node", "deviations"))
        return found

    def pixels(self) -> DataFrame:
        for number in range(1, len(self.skeleton.kinds) + 1):
            if self.skeleton.base(number) == number:
                self.branches[number] = self.node(number)
        return self.at(self.skeleton.output).px


def groups_of(recipes: DataFrame, luts: DataFrame | None) -> tuple[DataFrame, list[Group]]:
    """The prepared rows of photos that can be rendered, and their shapes by skeleton."""
    ensure_checkpoint_dir(recipes.sparkSession)
    rows = prepared(recipes)
    rows = rows.join(refused(rows, luts).select("image_id").distinct(), "image_id", "left_anti")
    rows = rows.checkpoint()  # one short row per photo, read again by every node
    return rows, grouped(r[0] for r in rows.select("shape").distinct().toLocalIterator())


def _plans(px: DataFrame, frames: DataFrame, recipes: DataFrame, luts: DataFrame | None, lens_map: DataFrame | None,
           tile: int) -> Iterator[tuple[str, Plan]]:
    rows, groups = groups_of(recipes, luts)
    for group in groups:
        mine = rows.where(F.col("shape").isin(list(group.shapes))).select("image_id")
        held = frames.join(mine, "image_id").withColumn("scaled_pixels", F.col("width").cast("long") * F.col("height"))
        source = Branch(px.join(mine, "image_id", "left_semi").select("image_id", "y", "x", *grading.RGB), held)
        yield group.skeleton.key, Plan(group, source, rows, luts, lens_map, tile)


def render_by_skeleton(px: DataFrame, frames: DataFrame, recipes: DataFrame, luts: DataFrame | None = None,
                       lens_map: DataFrame | None = None, tile: int = 512) -> Iterator[tuple[str, DataFrame]]:
    """(skeleton, display-space pixels) per distinct skeleton, to be written one after another.

    `frames` has (image_id, width, height, orientation, full_pixels, as_shot_kelvin, grain_seed), `recipes` (image_id, recipe,
    recipe_output), well formed. Only the distinct shapes, a short text each, come to the driver; there are as many as presets.
    """
    for key, plan in _plans(px, frames, recipes, luts, lens_map, tile):
        yield key, plan.pixels()


def render_to(folder: str, px: DataFrame, frames: DataFrame, recipes: DataFrame, luts: DataFrame | None = None,
              lens_map: DataFrame | None = None, tile: int = 512) -> DataFrame:
    """Render into a folder, one part for each skeleton, and read the pixels back.

    A part counts once it is written whole, so a job that stopped goes on with the parts that are missing. The folder belongs
    to one set of pixels and recipes.
    """
    spark = px.sparkSession
    paths = []
    for key, plan in _plans(px, frames, recipes, luts, lens_map, tile):
        paths.append(f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{paths[-1]}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            plan.pixels().write.mode("overwrite").parquet(paths[-1])
    schema = px.select("image_id", "y", "x", *grading.RGB).schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def noise_profiles(px: DataFrame, frames: DataFrame, recipes: DataFrame, luts: DataFrame | None = None,
                   lens_map: DataFrame | None = None, tile: int = 512) -> Iterator[DataFrame]:
    """(image_id, node, deviations) per skeleton with filters: the noise of the whole frame before each filter, for `window.render`."""
    for _, plan in _plans(px, frames, recipes, luts, lens_map, tile):
        plan.pixels()
        for found in plan.measured:
            yield found


def warnings(rows: DataFrame, lens_map: DataFrame | None) -> DataFrame:
    """(image_id, cause) of photos, as from `prepared`, that ask for lens correction but have no lens map: they keep their geometry."""
    asked = rows.where(F.exists("nodes", lambda n: (n["kind"] == "optics") & (n["p"][0] != 0))).select("image_id")
    if lens_map is not None:
        asked = asked.join(lens_map.select("image_id").distinct(), "image_id", "left_anti")
    return asked.withColumn("cause", F.lit("no lens map"))


def refused(rows: DataFrame, luts: DataFrame | None) -> DataFrame:
    """(image_id, cause) of photos, as from `prepared`, whose film nodes name a LUT that is not there."""
    film = rows.select("image_id", F.explode("nodes").alias("n")).select("image_id", "n.lut_id", F.col("n.p")[0].alias("strength"))
    asked = film.where("lut_id IS NOT NULL AND strength > 0")
    missing = asked if luts is None else grading.absent_luts(asked, luts)
    return missing.select("image_id", F.concat(F.lit("lut "), F.col("lut_id")).alias("cause"))


def unrendered(frames: DataFrame, rendered: DataFrame) -> DataFrame:
    """(image_id) of frames that gave no pixels: their recipe was refused."""
    return frames.select("image_id").join(rendered.select("image_id").distinct(), "image_id", "left_anti")


def flat_settings(px: DataFrame, frames: DataFrame, settings: DataFrame, max_width: int = 0, max_height: int = 0,
                  **kw) -> Iterator[tuple[str, DataFrame]]:
    """Flat settings as pixels: reduce first, then the recipe they stand for.

    `settings` has (image_id, effective, disabled).
    """
    if max_width or max_height:
        sizes = geometry.target_size(frames, F.lit(max_width), F.lit(max_height))
        px = geometry.downscale(px, sizes)
        frames = sizes.withColumns({"width": F.col("tw"), "height": F.col("th")}).drop("tw", "th")
    nodes = settings.select("image_id", S.to_recipe(F.col("effective"), F.col("disabled")).alias("recipe"))
    return render_by_skeleton(px, frames, nodes.withColumn("recipe_output", F.size("recipe")), **kw)


def set_params(nodes: Column, node_id: Column, params: Column) -> Column:
    return F.transform(nodes, lambda n: F.when(n["id"] == node_id, n.withField("params", params)).otherwise(n))


def negative_recipe(recipes: DataFrame, found: DataFrame, crop_node: int, subtract_node: int) -> DataFrame:
    """Write each photo's detected frame into its crop node and the film base into its subtraction.

    `found` comes from `measure.negative_frames`; base levels are held within 0..4.
    """
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(4.0))
    crop = F.create_map(*[x for k, c in (("left", "rect_left"), ("top", "rect_top"), ("width", "rect_width"), ("height", "rect_height"),
                                         ("angle", "angle")) for x in (F.lit(k), F.col(c))])
    base = F.create_map(*[x for k, c in (("red", "base_r"), ("green", "base_g"), ("blue", "base_b")) for x in (F.lit(k), held(c))])
    joined = recipes.join(found, "image_id")
    return joined.withColumn("recipe", set_params(set_params(F.col("recipe"), F.lit(crop_node), crop), F.lit(subtract_node), base)).select(*recipes.columns)
