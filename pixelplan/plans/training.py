"""Queries on training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import training
from ..registry import query
from ..sources import projections as src

LOSSES = "(select (user_id % 5)::integer fold, row_number() over (partition by user_id % 5 order by event_id)::integer epoch, value val_mae from events)"
_BEST = f"(select *, coalesce(val_mae < best_before, true) is_best from (select *, min(val_mae) over (partition by fold order by epoch rows between unbounded preceding and 1 preceding) best_before from {LOSSES}))"


@query(f"select fold, epoch, val_mae, best_before, is_best from {_BEST}")
def running_best(spark, sf_dir):
    return training.running_best(src.losses(spark, sf_dir))


@query(
    f"with s as (select *, max(case when is_best then epoch end) over (partition by fold order by epoch) since from {_BEST}), t as (select fold, coalesce(min(epoch) filter (epoch - since >= 25), max(epoch)) stop_epoch from s group by 1) "
    f"select t.fold, stop_epoch, min(val_mae) best from t join {LOSSES} l on l.fold = t.fold and epoch <= stop_epoch group by 1, 2",
)
def early_stop(spark, sf_dir):
    return training.early_stop(src.losses(spark, sf_dir), DEFAULTS["early_stop_patience"])


@query(
    f"with f as (select fold, count(*) epochs, min(val_mae) best, (min({{'v': val_mae, 'e': epoch}})).e best_epoch from {LOSSES} group by 1) "
    "select fold, epochs, best, best_epoch, mean_best, std_best, all_epochs from f, (select round(avg(best), 6) mean_best, round(stddev_pop(best), 6) std_best, sum(epochs)::bigint all_epochs from f)",
)
def fold_summary(spark, sf_dir):
    return training.fold_summary(src.losses(spark, sf_dir))


@query(f"select fold, epoch, val_mae * 2 train_total, val_mae from {LOSSES}")
def loss_unpivot(spark, sf_dir):
    rows = src.losses(spark, sf_dir)
    runs = rows.groupBy("fold", training.block().alias("run"))
    arrays = runs.agg(F.min("epoch").alias("first"), F.array_sort(F.collect_list(F.struct("epoch", "val_mae"))).alias("e"))
    histories = arrays.select("fold", "first", F.transform("e", lambda x: x["val_mae"] * 2).alias("train_total"), F.transform("e", lambda x: x["val_mae"]).alias("val_mae"))
    return training.unpivoted(histories, "first")


@query(f"select fold, epoch, round(1e-4::double * case when epoch <= 5 then epoch / 5.0::double else 1 end, 12) lr from {LOSSES}")
def warmup_lr(spark, sf_dir):
    """The rate of each epoch of each fold before any cut; histories count epochs from 1."""
    return src.losses(spark, sf_dir).select("fold", "epoch", F.round(training.warmup(F.col("epoch") - 1, DEFAULTS["lr"], DEFAULTS["warmup_epochs"]), 12).alias("lr"))


@query(
    f"with recursive l as materialized (select * from {LOSSES}), w as (select fold, 0 epoch, 1e-4::double lr, null::double best, 0 bad from (select distinct fold from l) union all "
    "select fold, epoch, case when bad > 8 then greatest(lr * 0.5::double, 1e-6::double) else lr end, best, case when bad > 8 then 0 else bad end from (select l.fold, l.epoch, w.lr, case when better then l.val_mae else w.best end best, case when better then 0 else w.bad + 1 end bad "
    "from w join (select * from l) l on l.fold = w.fold and l.epoch = w.epoch + 1, lateral (select l.val_mae is not null and (w.best is null or l.val_mae < w.best * (1 - 1e-4::double)) better))) "
    "select fold, epoch, lr from w where epoch > 0"
)
def plateau_lr(spark, sf_dir):
    return training.plateau_rates(src.losses(spark, sf_dir), DEFAULTS["lr"], DEFAULTS["lr_factor"], DEFAULTS["lr_patience"])
