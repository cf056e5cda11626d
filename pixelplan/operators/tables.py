"""Operators on tables of sites, tiles, files and crowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def draw(key: str) -> Column:
    """A fixed number of 0 to 1000002 for each key, in place of a random draw."""
    return (F.col(key) * F.lit(2654435761)) % 1000003


def discover_sites(photos: DataFrame, crowns: DataFrame) -> DataFrame:
    """Every photo's site with its number of crowns; annotations without a photo are left out."""
    counts = crowns.groupBy("site").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return photos.join(counts, "site", "left").select("site", n.alias("crowns"), (n == 0).alias("true_negative"))


_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with number, from 1, in this order over the whole table: a range's offset plus the place within the range.

    Rows are dealt by ranges, sorted there and kept with their places; only the ranges' sizes are added up in one
    place. Rows equal in all of the order are numbered in any way.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", _before("_n", Window.orderBy("_part")).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + within + 1).drop("_part", "_start", "_at")


def _before(n: str, order: Window) -> Column:
    return F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _same(keys: list[str]) -> Column:
    """Whether keys equal those of a table that has them as _k0, _k1 ...; null is a key like others."""
    out = F.lit(True)
    for k, key in enumerate(keys):
        out = out & F.col(key).eqNullSafe(F.col(f"_k{k}"))
    return out


def _keyed(keys: list[str]) -> list[Column]:
    return [F.col(key).alias(f"_k{k}") for k, key in enumerate(keys)]


#: Keys whose starts are sent to all executors; more meet the rows by a shuffle with a salt.
SENT_KEYS = 1 << 16
SALT = 16


def numbered_within(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with number, from 1, in this order within each key, and size, the key's rows.

    Numbers of the whole table less those of the keys before, so a key with a third of all rows is no large task: the rows of
    a key stay where they are, or are dealt with a salt if keys are many.
    """
    placed = numbered(rows, *keys, *order)
    starts = kept(placed.groupBy(*_keyed(keys)).agg((F.min("number") - 1).alias("_start"), F.count("*").alias("size")))
    if starts.count() <= SENT_KEYS:
        met = placed.join(F.broadcast(starts), _same(keys))
    else:
        dealt = starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = placed.join(dealt, _same(keys) & (F.pmod(F.col("number"), F.lit(SALT)) == F.col("_salt"))).drop("_salt")
    return met.withColumn("number", F.col("number") - F.col("_start")).drop("_start", *(f"_k{k}" for k in range(len(keys))))


def median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The exact median of each key's values that are not null: keys, median; keys without a value have no row. Without keys there is one row.

    Equal values are counted first. The counts are summed up over ranges of (keys, value), which are bounded, and
    the values at the two middle ranks are picked; so neither a large key nor a frequent value is a large task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = kept(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_s"))
    starts = sums.select("_part", _before("_s", Window.orderBy("_part")).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*keys, "_v")
    placed = dealt.join(F.broadcast(starts), "_part").withColumn("_from", F.col("_start") + _before("_n", own))
    first = placed.groupBy(*_keyed(list(keys))).agg(F.min("_from").alias("_first"), F.sum("_n").alias("_all"))
    both = placed.join(first, _same(list(keys))) if keys else placed.crossJoin(F.broadcast(first))
    at = F.col("_from") - F.col("_first")
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    picked = [F.max(F.when((at <= k) & (k < at + F.col("_n")), F.col("_v"))) for k in (low, high)]
    return both.groupBy(*keys).agg(((picked[0] + picked[1]) / 2).alias("median"))


def stratified_split(tiles: DataFrame, site: str, key: str, test_frac: float) -> DataFrame:
    """split: test for exactly round(n * test_frac) tiles of each site, train for the others."""
    ranked = numbered_within(tiles.withColumn("_draw", draw(key)), [site], "_draw", key)
    return ranked.withColumn("split", F.when(F.col("number") <= F.round(F.col("size") * F.lit(test_frac)), "test").otherwise("train")).drop("_draw", "number", "size")


def folds(tiles: DataFrame, key: str, k: int) -> DataFrame:
    """fold: 0 to k - 1, of sizes that differ by one at most; the first n mod k folds are larger."""
    order = tiles.withColumn("_draw", draw(key))
    placed = numbered(order, "_draw", key).crossJoin(F.broadcast(tiles.agg(F.count("*").alias("_n"))))
    small, large = F.expr(f"_n div {k}"), F.expr(f"_n % {k}")
    at = F.col("number") - 1
    head = (small + 1) * large
    fold = F.when(at < head, F.floor(at / (small + 1))).otherwise(large + F.floor(F.try_divide(at - head, small)))
    return placed.withColumn("fold", fold.cast("int")).drop("_draw", "_n", "number")


def site_weights(tiles: DataFrame, site: str = "site") -> DataFrame:
    """weight: one over the tiles of the site, by a count and a join, so a large site is no large task."""
    counts = tiles.groupBy(site).agg(F.count("*").alias("_n"))
    return tiles.join(counts, site).withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def draw_tiles(tiles: DataFrame, draws: DataFrame, key: str, site: str = "site") -> DataFrame:
    """The tile of each draw u in [0, 1), with replacement, each tile weighing one over the tiles of its site.

    Tiles stand one after another by site and key with their weights, so a site's weights add up to one: the whole
    part of u times the number of sites tells the site, the rest the place within it. Both sides meet by equality.
    """
    placed = numbered_within(tiles.select(site, key), [site], key)
    sites = numbered(placed.select(site, "size").distinct(), site).select(F.col(site).alias("_site"), (F.col("number") - 1).alias("_i"), "size")
    at = F.col("u") * F.col("_m")
    drawn = draws.crossJoin(F.broadcast(sites.agg(F.count("*").alias("_m")))).withColumns({"_i": F.floor(at), "_rest": at - F.floor(at)})
    drawn = drawn.join(sites, "_i").select("draw", "_site", (F.floor(F.col("_rest") * F.col("size")) + 1).alias("_k"))
    return drawn.join(placed, F.col("_site").eqNullSafe(F.col(site)) & (F.col("_k") == F.col("number"))).select("draw", site, key)


def accept_tiles(tiles: DataFrame, key: str, min_frac: float, keep_rate: float) -> DataFrame:
    """Tiles with crowns enough, and of those without any a share."""
    return tiles.where((F.col("crown_frac") >= min_frac) | (F.col("crown_frac") == 0) & (draw(key) / F.lit(1000003.0) < keep_rate))


def year_dimension(years: DataFrame, fine_since: int, service: str = "Imagery_%d", fine: int = 20, coarse: int = 19) -> DataFrame:
    """yr, service, zoom (finer from a year on) and ground_cm of a table of years."""
    from ..functions.mercator import ground_resolution_cm

    placed = years.select("yr", F.format_string(service, "yr").alias("service"), F.when(F.col("yr") >= fine_since, fine).otherwise(coarse).alias("zoom"))
    return placed.withColumn("ground_cm", F.round(ground_resolution_cm(F.col("zoom")), 2))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is wanted and not in the manifest."""
    return wanted.join(done, key, "left_anti")


def first_present(files: DataFrame, key: str) -> DataFrame:
    """Of each key the path of the lowest priority among files that are present."""
    return files.where("present").groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def f1_by_group(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall and F1 by size class, over all and by site, from rows of kind (tp, fp, fn), site and size_class.

    Every class has a row, of zeros if nothing is of it.
    """
    from ..functions.crowns import f1_scores

    spark = rows.sparkSession
    sums = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    sets = rows.groupingSets([["size_class"], ["site"], []], "size_class", "site").agg(F.grouping_id().alias("g"), *sums)
    grouping = F.when(F.col("g") == 1, "size_class").when(F.col("g") == 2, "site").otherwise("overall")
    label = F.when(F.col("g") == 1, F.col("size_class")).when(F.col("g") == 2, F.col("site").cast("string")).otherwise("all")
    found = sets.select(grouping.alias("grouping"), label.alias("label"), "tp", "fp", "fn")
    spine = spark.createDataFrame([("size_class", c) for c in classes] + [("overall", "all")], "grouping string, label string")
    keys = ["grouping", "label"]
    full = found.join(F.broadcast(spine), keys, "full").select(*keys, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return full.select(*keys, "tp", "fp", "fn", *f1_scores(F.col("tp"), F.col("fp"), F.col("fn")))
