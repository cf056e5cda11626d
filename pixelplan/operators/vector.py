"""Operators on polygons, downloads and mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings
from ..storage import kept
from .stats import with_median
from .tables import numbered_within


def parts(polygons: DataFrame) -> DataFrame:
    """One row for each part that has points: key, part (from 0), ring."""
    return _parts(polygons, "key")


def _parts(polygons: DataFrame, *keys: str) -> DataFrame:
    # Outer, as posexplode() has Spark ask for the size of parts as early as the read, where few tasks would work them all out.
    return polygons.select(*keys, F.posexplode_outer("parts").alias("part", "ring")).where(F.size("ring") > 0)


def total_bounds(parts_: DataFrame) -> DataFrame:
    boxed = parts_.select("*", *rings.bounds(F.col("ring")), rings.area(F.col("ring")).alias("_area"))
    return boxed.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.round(F.sum("_area"), 4).alias("area"), F.coalesce(F.bool_or(F.col("part") > 0), F.lit(False)).alias("multi"))


def spans(parts_: DataFrame) -> DataFrame:
    """key, part, r, c0, c1: the runs of pixels of unit size in each row whose centre lies in a ring, by its crossings with the row's middle.

    An edge gives one crossing for each row that it spans; a ring's crossings of a row are put in order, and every second
    gap between them is inside. Rings of any length are so many tasks' work as they have edges; repeated rings stay apart.
    """
    n = F.greatest(F.size("ring") - 1, F.lit(0))
    edges = F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    each = parts_.withColumn("_id", F.monotonically_increasing_id()).select("_id", "key", "part", F.explode(edges).alias("e")).where("e.p.y <> e.q.y")
    low, high = F.ceil(F.least("e.p.y", "e.q.y") - 0.5), F.ceil(F.greatest("e.p.y", "e.q.y") - 0.5) - 1
    crossed = each.where(low <= high).select("_id", "key", "part", "e", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("r"))
    x = F.expr("(e.q.x - e.p.x) * (r + 0.5D - e.p.y) / (e.q.y - e.p.y) + e.p.x")
    rows = crossed.groupBy("_id", "key", "part", "r").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    gaps = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda k: F.struct(F.ceil(F.get("xs", k) - 0.5).cast("int").alias("c0"), (F.ceil(F.get("xs", k + 1) - 0.5) - 1).cast("int").alias("c1")))
    return rows.select("key", "part", "r", F.explode(gaps).alias("g")).select("key", "part", "r", "g.c0", "g.c1").where("c0 <= c1")


def rasterized(parts_: DataFrame) -> DataFrame:
    """key, part, r, c of the pixels of unit size whose centre lies in a ring."""
    return spans(parts_).select("key", "part", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def union_area(parts_: DataFrame) -> DataFrame:
    """area: of what parts cover together, in pixels of unit size, each counted once; exact for rings on whole numbers.

    Runs of one row are put in order and only what reaches beyond those before counts; no pixel is made.
    """
    before = F.max("c1").over(Window.partitionBy("r", "_k").orderBy("c0").rowsBetween(Window.unboundedPreceding, -1))
    width = 1024  # columns of a group, so that a long row is many
    lo, hi = F.greatest("c0", F.col("_k") * width), F.least("c1", F.col("_k") * width + (width - 1))
    cut = spans(parts_).select("r", "c0", "c1", F.explode(F.sequence(F.floor(F.col("c0") / F.lit(width)), F.floor(F.col("c1") / F.lit(width)))).alias("_k"))
    cut = cut.select("r", "_k", lo.alias("c0"), hi.alias("c1")).groupBy("r", "_k", "c0").agg(F.max("c1").alias("c1"))
    fresh = F.greatest(F.lit(0), F.col("c1") - F.greatest(F.col("c0"), F.coalesce(before + 1, "c0")) + 1)
    return cut.select(fresh.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("area"))


#: Rings of a cell that are swept; a cell with more is quartered, but for the smallest, of 1 / 2 ** HALVINGS of the first edge.
FEW_RINGS, HALVINGS = 8, 10


def _cells(parts_: DataFrame, keys: tuple[str, ...], cell: float) -> tuple[DataFrame, DataFrame]:
    """Cells that must be swept, as rows of keys, i, j, s (edge) and ring for each ring that has a side in the cell; and keys
    and area of the cells that some ring holds as a whole.

    Cells with many rings are quartered in rounds. What one ring holds needs no sweep whatever else is there, so where rings lie in
    many layers only the cells along the rim of what they cover go on. Equal rings are one.
    """
    own = [*keys, "i", "j"]
    low, high = (lambda x, f=f: F.floor(f(F.transform("ring", lambda p: p[x])) / F.lit(cell)).cast("long") for f in (F.array_min, F.array_max))
    rings_ = parts_.where(F.size("ring") > 3).select(*keys, "ring").dropna(subset=list(keys)).distinct()
    rows = rings_.select("*", F.explode(F.sequence(low("x"), high("x"))).alias("i")).select("*", F.explode(F.sequence(low("y"), high("y"))).alias("j"))
    swept, whole = None, None
    for level in range(HALVINGS + 1):
        size = cell / 2**level
        x0, y0, x1, y1 = (F.col("i") * F.lit(size), F.col("j") * F.lit(size), (F.col("i") + 1) * F.lit(size), (F.col("j") + 1) * F.lit(size))
        rows = rows.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1})
        between = lambda p, q, c: (F.least(p[c], q[c]) < F.col(f"_{c}1")) & (F.greatest(p[c], q[c]) > F.col(f"_{c}0"))
        turn = lambda p, q, x, y: (q["x"] - p["x"]) * (F.col(y) - p["y"]) - (q["y"] - p["y"]) * (F.col(x) - p["x"])
        sides = lambda p, q: [turn(p, q, x, y) for x in ("_x0", "_x1") for y in ("_y0", "_y1")]
        met = lambda p, q: between(p, q, "x") & between(p, q, "y") & (F.least(*sides(p, q)) < 0) & (F.greatest(*sides(p, q)) > 0)
        n = F.size("ring") - 1
        part = F.exists(F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), met), lambda m: m)
        placed = rows.withColumn("_part", part).withColumn("_full", ~F.col("_part") & rings.contains(F.col("ring"), (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2))
        placed = kept(placed.where("_part or _full").select(*own, "ring", "_full"))
        held = placed.groupBy(*own).agg(F.bool_or("_full").alias("_held"), F.count("*").alias("_n"))
        areas = held.where("_held").select(*keys, F.lit(size * size).alias("area"))
        open_ = placed.join(held.where("not _held").hint("merge"), own)
        few = (open_ if level == HALVINGS else open_.where(F.col("_n") <= FEW_RINGS)).select(*own, F.lit(size).alias("s"), "ring")
        swept, whole = (few, areas) if swept is None else (swept.unionByName(few), whole.unionByName(areas))
        many = open_.where(F.col("_n") > FEW_RINGS)
        if level == HALVINGS or held.where(~F.col("_held") & (F.col("_n") > FEW_RINGS)).isEmpty():
            break
        half = lambda x: F.explode(F.array(F.col(x) * 2, F.col(x) * 2 + 1)).alias(x)
        rows = many.select(*keys, half("i"), "j", "ring").select(*keys, "i", half("j"), "ring")
    return swept, whole


def covered_area(parts_: DataFrame, *keys: str, cell: float = 64.0) -> DataFrame:
    """area that the rings of equal keys cover together, for rings anywhere: each place counts once, however many cover it.

    A sweep in cells of the plane, which are quartered where many rings meet and count as a whole where one ring holds
    them. In a cell a ring's edges are cut to it; what lies to its left is moved to its left side,
    which leaves as they are the turns of the ring around places inside, and equal pieces are added up. The pieces' ends
    and crossings cut the cell to strips in which no two pieces cross; from left to right the turns are summed up, and
    what lies between two pieces with turns is a trapezoid. Rings must not cross themselves (repair them first).
    """
    n, turn = F.greatest(F.size("ring") - 1, F.lit(0)), F.when(rings.signed_area(F.col("ring")) < 0, -1).otherwise(1)
    ends = F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda p, q: F.struct(F.when(p["y"] < q["y"], p).otherwise(q).alias("a"), F.when(p["y"] < q["y"], q).otherwise(p).alias("b"), F.when(p["y"] < q["y"], F.lit(1)).otherwise(-1).alias("way")))
    cells, whole = _cells(parts_, keys, cell)
    each = cells.select(*keys, "i", "j", "s", turn.alias("turn"), F.explode(ends).alias("e")).where("e.a.y < e.b.y")
    x0, x1 = F.col("i") * F.col("s"), (F.col("i") + 1) * F.col("s")
    lo, hi = F.greatest(F.col("e.a.y"), F.col("j") * F.col("s")), F.least(F.col("e.b.y"), (F.col("j") + 1) * F.col("s"))
    sent = each.where((lo < hi) & (F.least("e.a.x", "e.b.x") < x1)).withColumn("way", (F.col("e.way") * F.col("turn")).cast("int"))
    rows = sent.select(*keys, "i", "j", "s", "way", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"), lo.alias("lo"), hi.alias("hi"), x0.alias("x0"), x1.alias("x1"))
    y_at = lambda x: F.expr(f"ay + ({x} - ax) * (by - ay) / nullif(bx - ax, 0)")
    rows = rows.withColumns({"y0": y_at("x0"), "y1": y_at("x1")})
    x_at = lambda y: f"ax + ({y} - ay) * (bx - ax) / (by - ay)"
    left_lo = F.expr("case when ax = bx then case when ax < x0 then lo else hi end when bx > ax then lo else greatest(lo, y0) end")
    left_hi = F.expr("case when ax = bx then hi when bx > ax then least(hi, y0) else hi end")
    mid_lo = F.expr("case when ax = bx then case when ax >= x0 and ax < x1 then lo else hi end when bx > ax then greatest(lo, y0) else greatest(lo, y1) end")
    mid_hi = F.expr("case when ax = bx then hi when bx > ax then least(hi, y1) else least(hi, y0) end")
    cut = rows.withColumns({"ll": left_lo, "lh": left_hi, "ml": mid_lo, "mh": mid_hi})
    piece = lambda a, b, u, v: F.struct(a.alias("lo"), b.alias("hi"), u.alias("u"), v.alias("v"))
    made = F.array(piece(F.col("ll"), F.col("lh"), F.col("x0"), F.col("x0")), piece(F.col("ml"), F.col("mh"), F.expr(x_at("ml")), F.expr(x_at("mh"))))
    own = [*keys, "i", "j", "s"]
    pieces = cut.select(*own, "way", F.explode(F.filter(made, lambda p: p["lo"] < p["hi"])).alias("p")).groupBy(*own, "p.lo", "p.hi", "p.u", "p.v").agg(F.sum("way").alias("way")).where("way <> 0")
    pieces = kept(pieces.toDF(*own, "lo", "hi", "u", "v", "way"))
    # Crossings: over the heights that two pieces share, the one that is left at the bottom is right at the top.
    # They are looked for in eighths of a cell, so that only pieces near each other meet. Tables here are far larger than
    # what is guessed from the files, so none is broadcast.
    fine = lambda low, high: F.explode(F.sequence(F.floor(low * 8 / F.col("s")), F.floor(high * 8 / F.col("s"))))
    near = pieces.withColumn("_y", fine(F.col("lo"), F.col("hi"))).withColumn("_x", fine(F.least("u", "v"), F.greatest("u", "v")))
    a, b = (near.select(*own, "_y", "_x", *(F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "u", "v"))) for s in ("a", "b"))
    both = a.hint("merge").join(b, [*own, "_y", "_x"]).where("lo_a < hi_b and lo_b < hi_a and least(u_a, v_a) <= greatest(u_b, v_b) and least(u_b, v_b) <= greatest(u_a, v_a) and struct(lo_a, hi_a, u_a, v_a) < struct(lo_b, hi_b, u_b, v_b)")
    both = both.withColumns({"l": F.greatest("lo_a", "lo_b"), "h": F.least("hi_a", "hi_b")})
    gap = lambda y: f"(u_a + ({y} - lo_a) * (v_a - u_a) / (hi_a - lo_a)) - (u_b + ({y} - lo_b) * (v_b - u_b) / (hi_b - lo_b))"
    met = both.withColumns({"g": F.expr(gap("l")), "k": F.expr(gap("h"))}).where("g * k < 0").select(*own, F.expr("l + g / (g - k) * (h - l)").alias("y"))
    heights = pieces.select(*own, F.explode(F.array("lo", "hi")).alias("y")).unionByName(met).groupBy(*own).agg(F.array_sort(F.collect_set("y")).alias("ys"))
    steps = F.filter(F.arrays_zip(F.slice("ys", 1, F.size("ys") - 1).alias("s"), F.slice("ys", 2, F.size("ys") - 1).alias("t")), lambda z: (z["s"] >= F.col("lo")) & (z["t"] <= F.col("hi")))
    strips = pieces.hint("merge").join(heights, own).select(*own, "lo", "hi", "u", "v", "way", F.explode(steps).alias("z"))
    placed = strips.select(*own, F.col("z.s").alias("_s"), (F.col("z.t") - F.col("z.s")).alias("t"), "way", F.expr("u + ((z.s + z.t) / 2 - lo) * (v - u) / (hi - lo)").alias("x"))
    line = Window.partitionBy(*own, "_s").orderBy("x")
    open_ = placed.withColumns({"turns": F.sum("way").over(line.rowsBetween(Window.unboundedPreceding, 0)), "next": F.coalesce(F.lead("x").over(line), (F.col("i") + 1) * F.col("s"))})
    found = open_.where("turns <> 0").select(*keys, ((F.col("next") - F.col("x")) * F.col("t")).alias("area")).unionByName(whole)
    return found.groupBy(*keys).agg(F.sum("area").alias("area"))


def painted(pixels: DataFrame, order: str) -> DataFrame:
    """Where several polygons cover a pixel the later one stays."""
    return pixels.groupBy("r", "c").agg(F.max(order).alias(order))


def download_report(downloads: DataFrame) -> DataFrame:
    """Tiles by status: 200 is a tile, 404 missing for good, 429 to be tried again, others failed."""
    outcome = F.when(F.col("status") == 200, "tile").when(F.col("status") == 404, "missing").when(F.col("status") == 429, "retry").otherwise("failed")
    counts = downloads.groupBy("status", outcome.alias("outcome")).agg(F.count("*").alias("tiles"))
    total = counts.agg(F.sum("tiles").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "outcome", "tiles", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("tiles"), F.col("total")), F.lit(0.0)), 6).alias("percent"))


def attempts(tries: DataFrame, key: str, most: int = 3) -> DataFrame:
    """What became of each tile: its tries in order until one is final, `most` at most.

    tries: key, attempt (from 0), status (null: an exception), image. 200 with an image is a tile; 429 waits
    2 ** attempt seconds and an exception 1 second, and both try again; all else ends without a tile, and so do tries
    that are used up. Returns key, outcome (tile or missing), tries (made), waited (seconds).
    """
    again = F.col("status").isNull() | (F.col("status") == 429)
    rows = tries.where(F.col("attempt") < most)
    last = rows.groupBy(key).agg(F.coalesce(F.min(F.when(~again, F.col("attempt"))), F.lit(most - 1)).alias("_last"))
    got = F.bool_or((F.col("attempt") == F.col("_last")) & (F.coalesce("status", F.lit(0)) == 200) & F.col("image"))
    made = rows.join(last, key).where("attempt <= _last")
    wait = F.sum(F.when(F.col("status").isNull(), F.lit(1)).when(F.col("status") == 429, F.pow(F.lit(2), "attempt").cast("long")).otherwise(0))
    return made.groupBy(key).agg(F.when(got, "tile").otherwise("missing").alias("outcome"), F.count("*").alias("tries"), wait.cast("long").alias("waited"))


def mosaic(pixels: DataFrame, tiles: int, edge: int) -> DataFrame:
    """strip, y, x, v: the pixels of tiles (strip, slot, r, c, v) side by side; what is beyond a tile's edge is cut off and what no tile has is 0."""
    placed = pixels.where((F.col("r") < edge) & (F.col("c") < edge)).select("strip", F.col("r").alias("y"), (F.col("slot") * edge + F.col("c")).cast("int").alias("x"), "v")
    line = pixels.select("strip").distinct().select("strip", F.explode(F.sequence(F.lit(0), F.lit(edge - 1))).alias("y"))
    spine = line.select("strip", "y", F.explode(F.sequence(F.lit(0), F.lit(tiles * edge - 1))).alias("x"))
    return spine.join(placed, ["strip", "y", "x"], "left").select("strip", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def mosaic_cells(pixels: DataFrame, tiles: int, edge: int) -> DataFrame:
    """strip, y, x, v as mosaic() has them, without the places that no tile has; a pixel that is cut off has no x, so that its strip is known."""
    x = F.col("slot") * edge + F.col("c")
    inside = F.col("r").between(0, edge - 1) & (F.col("c") < edge) & x.between(0, tiles * edge - 1)
    return pixels.select("strip", F.when(inside, F.col("r")).otherwise(0).alias("y"), F.when(inside, x).cast("int").alias("x"), "v")


def strip_layout(rows: DataFrame, tiles: int, batch: int = 20) -> DataFrame:
    """Every slot of every strip: its left edge, whether a tile came, and the batch it is fetched in."""
    came = rows.groupBy("strip", "slot").agg(F.bool_or("got").alias("got"))
    spine = came.select("strip").distinct().select("strip", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("slot"))
    full = spine.join(came, ["strip", "slot"], "left")
    return full.select("strip", "slot", (F.col("slot") * 256).alias("x"), F.coalesce("got", F.lit(False)).alias("present"), F.expr(f"cast(slot div {batch} as int)").alias("batch"))


#: Points of a ring whose pairs of edges are all looked at within its row; longer rings meet themselves strip by strip.
FEW_POINTS = 64


def crossing(parts_: DataFrame, *keys: str) -> DataFrame:
    """keys of the rings of which two edges that are no neighbours cross properly.

    Edges of long rings are sent to as many strips of the ring's height as it has eighths of points, and only those
    of one strip whose boxes overlap are compared.
    """
    few = parts_.where(F.size("ring") <= FEW_POINTS).where(rings.self_crossing(F.col("ring"))).select(*keys)
    box = {"lo": F.array_min(F.transform("ring", lambda p: p["y"])), "hi": F.array_max(F.transform("ring", lambda p: p["y"])), "n": F.size("ring") - 1}
    many = parts_.where(F.size("ring") > FEW_POINTS).withColumns(box)
    ends = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.alias("i"), F.element_at("ring", i.cast("int")).alias("p"), F.element_at("ring", (i + 1).cast("int")).alias("q")))
    strip = lambda y: F.floor(F.coalesce(F.try_divide((y - F.col("lo")) * (F.col("n") / 8), F.col("hi") - F.col("lo")), F.lit(0.0))).cast("int")
    edges = many.select(*keys, "lo", "hi", "n", F.explode(ends).alias("e"))
    low, high = strip(F.least("e.p.y", "e.q.y")), strip(F.greatest("e.p.y", "e.q.y"))
    sent = edges.select(*keys, "e", F.explode(F.sequence(low, high)).alias("strip"))
    a, b = (sent.select(*keys, "strip", F.col("e").alias(n)) for n in ("a", "b"))
    turn = lambda p, q, x: f"signum(({q}.x - {p}.x) * ({x}.y - {p}.y) - ({q}.y - {p}.y) * ({x}.x - {p}.x))"
    apart = F.expr(f"{turn('a.p', 'a.q', 'b.p')} * {turn('a.p', 'a.q', 'b.q')} < 0 and {turn('b.p', 'b.q', 'a.p')} * {turn('b.p', 'b.q', 'a.q')} < 0")
    near = F.expr("a.i < b.i and least(a.p.x, a.q.x) <= greatest(b.p.x, b.q.x) and least(b.p.x, b.q.x) <= greatest(a.p.x, a.q.x)")
    met = a.join(b, [*keys, "strip"]).where(near & apart).select(*keys)
    return few.unionByName(met).distinct()


def inspect(parts_: DataFrame) -> DataFrame:
    """Number of parts, those that cross or touch themselves, and the range and median of their areas."""
    from .repair import invalid

    rows = parts_.select(rings.area(F.col("ring")).alias("_area"))
    found = rows.agg(F.count("*").alias("parts"), F.min("_area").alias("low"), F.max("_area").alias("high"))
    found = found.crossJoin(F.broadcast(invalid(parts_, "key", "part").agg(F.count("*").alias("invalid"))))
    return with_median(found, rows, "_area", name="mid").select("parts", "invalid", "low", "mid", "high")


def cleaned(polygons: DataFrame, site: str, threshold: float, outlines: bool = True) -> DataFrame:
    """Polygons to crowns: parts as rows, bad rings repaired, slivers left out, numbered within each site from 0.

    Areas are kept before the rows are numbered, so that dealing by ranges, which reads its input twice, does not work them
    out again. Where outlines are not wanted there is no column rings, and none is moved.
    """
    from ..functions.crowns import size_class
    from .repair import area, repaired

    more = ["rings"] if outlines else []
    rows = kept(repaired(_parts(polygons, site, "key"), "key", "part").select(site, "key", "part", "piece", area(F.col("rings")).alias("area_m2"), *more))
    number = F.col("number") - 1
    numbers = numbered_within(rows.where(F.col("area_m2") >= threshold), [site], "key", "part", "piece")
    return numbers.select(F.concat(F.col(site), F.lit("_"), number.cast("string")).alias("crown_id"), F.col(site).alias("site"), "area_m2", size_class(F.col("area_m2")).alias("size_class"), *more)
