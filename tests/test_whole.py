"""Training histories of whole tables against plain loops."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry_points
from pixelplan.operators import training

DIR = "/root/testdata/sf0.01"
QUERIES = entry_points.queries()
@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for file in os.listdir(DIR):
        out.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DIR}/{file}'")
    return out


def rates(values, lr, factor, patience):
    rate, best, bad, out = lr, float("inf"), 0, []
    for v in values:
        best, bad = (v, 0) if v is not None and v < best * (1 - 1e-4) else (best, bad + 1)
        if bad > patience:
            rate, bad = max(rate * factor, 1e-6), 0
        out.append(rate)
    return out


def test_plateau_of_all_events(spark, con):
    events = con.execute("select user_id % 5, value from events order by event_id").fetchall()
    got = {}
    for x in QUERIES["plateau_lr"](spark, DIR).collect():
        got.setdefault(x.fold, {})[x.epoch] = x.lr
    assert sum(map(len, got.values())) == len(events)
    for fold, own in got.items():
        assert [own[k + 1] for k in range(len(own))] == rates([v for f, v in events if f == fold], 1e-4, 0.5, 8)


def test_histories_over_blocks_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 7)
    r = random.Random(5)
    folds = {f: [r.choice([None, round(r.uniform(90, 100) * 0.97**e, 2)]) if r.random() < 0.2 else round(r.uniform(90, 100) * 0.97 ** (e * (f or 0) / 3), 2) for e in range(80)] for f in (0, 1, 2, None)}
    rows = spark.createDataFrame([(f, e + 1, v) for f, own in folds.items() for e, v in enumerate(own)], "fold int, epoch int, val_mae double").repartition(4)
    best = {(x.fold, x.epoch): x.best_before for x in training.running_best(rows).collect()}
    lr = {(x.fold, x.epoch): x.lr for x in training.plateau_rates(rows, 1.0, 0.5, 2).collect()}
    for f, own in folds.items():
        assert [best[f, e + 1] for e in range(80)] == [min((v for v in own[:e] if v is not None), default=None) for e in range(80)]
        assert [lr[f, e + 1] for e in range(80)] == rates(own, 1.0, 0.5, 2)
