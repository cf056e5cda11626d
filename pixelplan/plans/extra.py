"""Queries on augmentation, samples, inspection and cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import augment, grids, repair, vector
from ..storage import folder
from ..streaming import retries
from ..registry import query
from ..sources import projections as src
from .maps import DOWNLOADS, PARTS
from .pixels import PIXELS


@query(
    f"select raster_id, turn, (case turn when 'flip_v' then 7 - r when 'transpose' then c when 'rot90' then 7 - c when 'rot180' then 7 - r when 'rot270' then c else r end)::integer r, "
    f"(case turn when 'flip_h' then 7 - c when 'transpose' then r when 'rot90' then r when 'rot180' then 7 - c when 'rot270' then 7 - r else c end)::integer c, v, "
    f"floor(pow(least(1.0::double, v / 255.0::double * 1.2::double), 0.8::double) * 255 + 0.5::double)::integer bright from {PIXELS}, (select unnest(['same', 'flip_h', 'flip_v', 'transpose', 'rot90', 'rot180', 'rot270']) turn)",
)
def augment_chips(spark, sf_dir):
    rows = src.pixels(spark, sf_dir)
    return augment.turned(rows, "raster_id", 8, "v").withColumn("bright", augment.brightened(F.col("v"), 1.2, 0.8))


@query(
    f"with k as (select unnest([-1, 0, 1]) d, unnest([1, 2, 1]) w), p as {PIXELS}, s as (select p.raster_id, p.r, p.c, a.w * b.w w, case when p.r + a.d < 0 then 1 when p.r + a.d > 7 then 6 else p.r + a.d end sr, case when p.c + b.d < 0 then 1 when p.c + b.d > 7 then 6 else p.c + b.d end sc from p, k a, k b) "
    "select s.raster_id, s.r, s.c, floor(sum(q.v * s.w) / 16.0::double + 0.5::double)::integer v from s join p q on q.raster_id = s.raster_id and q.r = sr and q.c = sc group by 1, 2, 3"
)
def augment_blur(spark, sf_dir):
    return augment.blurred(src.pixels(spark, sf_dir), "raster_id", 8)


@query(
    f"select raster_id, r, c, greatest(0, least(255, floor((v - 127.5::double) * 1.3::double + 137.5::double + 0.5::double)::integer)) contrast, floor(v * 0.9::double + 25.5::double + 0.5::double)::integer fog, "
    f"case when r between 1 and 2 and c between 3 and 6 then 0 else v end punched, case when r < 4 and c < 4 then floor(v * 0.5::double)::integer else v end shade from {PIXELS}"
)
def augment_values(spark, sf_dir):
    v = F.col("v")
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))))
    rows = src.pixels(spark, sf_dir)
    return rows.select("raster_id", "r", "c", augment.contrasted(v, 1.3, 10.0).alias("contrast"), augment.fogged(v, 0.1).alias("fog"), augment.punched(v, [(1, 3, 3, 7)]).alias("punched"), augment.shaded(v, square, 0.5).alias("shade"))


@query(
    "with g as (select (i // 8)::integer r, (i % 8)::integer c from (select unnest(range(64)) i)), m as (select r, c, floor(((r - 4.5::double) * cos(radians(30.0::double)) - (c - 2.5::double) * sin(radians(30.0::double))) / 1.1::double + 3.5::double + 0.5::double)::integer sr, "
    f"floor(((r - 4.5::double) * sin(radians(30.0::double)) + (c - 2.5::double) * cos(radians(30.0::double))) / 1.1::double + 3.5::double + 0.5::double)::integer sc from g) select raster_id, site_no, v, m.r, m.c from {PIXELS} p join m on p.r = sr and p.c = sc"
)
def augment_affine(spark, sf_dir):
    """Turned by 30 degrees, a tenth larger, one pixel down and one to the left."""
    return augment.moved(src.pixels(spark, sf_dir), "raster_id", 8, degrees=30.0, scale=1.1, down=1.0, right=-1.0)


@query(f"select site_no, raster_id, r, c, v from (select *, row_number() over (partition by site_no order by ((raster_id * 64 + r * 8 + c) * 2654435761) % 1000003, raster_id, r, c) rn from {PIXELS}) where rn <= 50")
def pixel_subsample(spark, sf_dir):
    """Of each site the 50 pixels of the lowest draws, as a histogram profile samples them."""
    draw = ((F.col("raster_id") * 64 + F.col("r") * 8 + F.col("c")) * F.lit(2654435761)) % 1000003
    ranked = src.pixels(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("site_no").orderBy(draw, "raster_id", "r", "c")))
    return ranked.where("rn <= 50").select("site_no", "raster_id", "r", "c", "v")


@query(f"select count(*) parts, count(*) filter (\"key\" % 4 in (1, 2)) invalid, min(a) low, median(a) mid, max(a) high from (select *, case when \"key\" % 4 = 1 then 0.0::double else w * h end a from {PARTS})")
def inspect_polygons(spark, sf_dir):
    return vector.inspect(vector.parts(src.broken_polygons(spark, sf_dir)))


_PIECES = f"(select \"key\", part, piece, case when \"key\" % 4 = 1 then w * h / 4 else w * h end area from {PARTS}, (select unnest([0, 1]) piece) where piece = 0 or \"key\" % 4 = 1)"


@query(f"select \"key\", part, piece, round(area, 6) area from {_PIECES}")
def repair_polygons(spark, sf_dir):
    """Outlines that cross themselves become two, spikes and repeated points go."""
    found = repair.repaired(vector.parts(src.broken_polygons(spark, sf_dir)), "key", "part")
    return found.select("key", "part", "piece", F.round(repair.area(F.col("rings")), 6).alias("area"))


@query(
    f"select 'S' || (\"key\" % 4)::varchar || '_' || (row_number() over (partition by \"key\" % 4 order by \"key\", part, piece) - 1)::varchar crown_id, 'S' || (\"key\" % 4)::varchar site, round(area, 6) area_m2, case when area <= 4.9 then 'small' when area <= 15.9 then 'medium' else 'large' end size_class from {_PIECES} where area >= 3"
)
def preprocess_crowns(spark, sf_dir):
    polygons = src.broken_polygons(spark, sf_dir).withColumn("site", F.concat(F.lit("S"), (F.col("key") % 4).cast("string")))
    return vector.cleaned(polygons, "site", 3.0, outlines=False).withColumn("area_m2", F.round("area_m2", 6))


@query(f"select id, col, ((row_number() over (partition by col order by id) - 1) // 20)::integer batch from {DOWNLOADS}")
def download_batches(spark, sf_dir):
    return grids.batches(src.downloads(spark, sf_dir), "id", 20, "col").select("id", "col", "batch")


@query("select p_type \"group\", count(*) tensors, sum((p_size * (p_size % 7 + 1) * 49)::bigint)::bigint numel from part group by 1")
def parameter_count(spark, sf_dir):
    """Parts stand for tensors, of a shape each, and types for the layers that hold them."""
    shape = F.array(F.col("p_size").cast("int"), (F.col("p_size") % 7 + 1).cast("int"), F.lit(7), F.lit(7))
    rows = src.table(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.aggregate(shape, F.lit(1).cast("long"), lambda n, x: n * x).alias("numel"))
    return rows.groupBy("group").agg(F.count("*").alias("tensors"), F.sum("numel").alias("numel"))


_DRAW = "(({h} * 48271 + {place} + 1) % 2147483647 * 48271 % 2147483647 / 2147483647.0::double * 2 - 1)"
_HASH = "((raster_id % 2147483647 * 48271 + {seed} * 40503) % 2147483647)"


def _draw(place: str, seed: int) -> str:
    return _DRAW.format(h=_HASH.format(seed=seed), place=place)


def _show(i: str) -> str:
    return f"least((({i}) % 14 + 14) % 14, 14 - (({i}) % 14 + 14) % 14)"


def _bilinear(sources: str) -> str:
    """SQL for the values of chips of 8 x 8 at sources (raster_id, r, c, y, x)."""
    return (
        f"select raster_id, r, c, floor(sum(v * w) + 0.5)::integer v from (select s.raster_id, s.r, s.c, {_show('floor(y)::bigint + a')} sr, {_show('floor(x)::bigint + b')} sc, (case a when 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case b when 1 then x - floor(x) else 1 - (x - floor(x)) end) w "
        f"from {sources} s, (values (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b)) join (select raster_id, r sr, c sc, v from {PIXELS}) using (raster_id, sr, sc) where w > 0 group by raster_id, r, c"
    )


_PLACES = "(select vec_id raster_id, (i // 8)::integer r, (i % 8)::integer c, i from embeddings, (select unnest(range(64)) i))"


@query(
    f"with n as materialized (select raster_id, r, c, {_draw('i', 42)} y, {_draw('i', 43)} x from {_PLACES}), k as (select d, exp(-d * d / 2.0::double) / sum(exp(-d * d / 2.0::double)) over () w from (select unnest(range(-3, 4)) d)), "
    f"h as materialized (select g.raster_id, g.r, g.c, sum(n.y * w) y, sum(n.x * w) x from {_PLACES} g, k, n where n.raster_id = g.raster_id and n.r = g.r and n.c = {_show('g.c + d')} group by 1, 2, 3), "
    f"f as (select g.raster_id, g.r, g.c, g.r + 2 * sum(h.y * w) y, g.c + 2 * sum(h.x * w) x from {_PLACES} g, k, h where h.raster_id = g.raster_id and h.c = g.c and h.r = {_show('g.r + d')} group by 1, 2, 3) " + _bilinear("f")
)
def augment_elastic(spark, sf_dir):
    """Chips bent by a smooth random field."""
    return augment.elastic(src.pixels(spark, sf_dir), "raster_id", 8, alpha=2.0, sigma=1.0)


def _stretch(at: str, which: int) -> str:
    factors = ", ".join(f"1 + 0.3::double * {_draw(str(k), 44 + which)}" for k in range(2))
    return f"(select b + f[k + 1] * 4 * ({at} - k * 4) / 3 from (select {at} // 4 k, [{factors}] f), lateral (select coalesce(list_sum(f[1:k]), 0) * 4 b))"


@query(f"with f as (select raster_id, r, c, {_stretch('r', 0)} y, {_stretch('c', 1)} x from {_PLACES}) " + _bilinear("f"))
def augment_grid(spark, sf_dir):
    """Chips stretched and squeezed in two steps of four pixels."""
    return augment.grid_distorted(src.pixels(spark, sf_dir), "raster_id", 8, steps=2, limit=0.3)


@query(
    f"with recursive a as materialized (select id // 20 tile, id % 20 n, case when status = 500 and id % 3 = 0 then null when status = 200 and id % 4 > 0 then 503 else status end status, id % 5 <> 0 image from {DOWNLOADS}), "
    "w as (select tile, 0::bigint n, 0 tries, 0 retries, 0.0::double waited, null::varchar outcome from (select distinct tile from a) union all "
    "select tile, n + 1, case when again then tries when bad then tries + 1 else tries end, case when again then retries + 1 when bad then 0 else retries end, waited + case when again then case when retries > 0 then 0.5::double * pow(2, retries) else 0 end when bad then 1 else 0 end, "
    "case when again then null when bad then case when tries = 2 then 'missing' end when status = 200 and image then 'tile' else 'missing' end "
    "from (select w.*, status, image, coalesce(status in (429, 500, 502, 503, 504), false) and retries < 5 again, status is null or status in (429, 500, 502, 503, 504) bad from w join a on a.tile = w.tile and a.n = w.n where outcome is null)) "
    "select tile, outcome, n::integer answers, waited from w where outcome is not null"
)
def download_retries(spark, sf_dir):
    """Twenty events in a row stand for the answers to a tile's requests; they come as a stream of files."""
    status = F.when((F.col("status") == 500) & (F.col("id") % 3 == 0), F.lit(None)).when((F.col("status") == 200) & (F.col("id") % 4 > 0), 503).otherwise(F.col("status"))
    answers = src.downloads(spark, sf_dir).select(F.expr("id div 20").alias("tile"), (F.col("id") % 20).cast("int").alias("n"), status.cast("int").alias("status"), (F.col("id") % 5 != 0).alias("image"))
    place = folder(spark, "answers")
    answers.write.parquet(f"{place}/in")
    stream = spark.readStream.schema(retries.ANSWERS).parquet(f"{place}/in")
    settled = retries.outcomes(stream, timeout=1e6).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    retries.replayed(settled)
    return spark.read.schema(retries.OUTCOMES).parquet(f"{place}/out")
