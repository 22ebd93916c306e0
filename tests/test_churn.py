import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import churn as CH
from ledgerlens.operators.sales import enrich_sales
from ledgerlens.sources import adapters as A
from ledgerlens.sources import ingest as I

PRED = "customerid string, churn_probability double"


def test_risk_bands_boundaries(spark):
    p = spark.createDataFrame([("a", 0.4), ("b", 0.7), ("c", 0.70001), ("d", None)], PRED)
    assert [tuple(r) for r in CH.risk_bands(p).collect()] == [(1, "High", 1), (2, "Medium", 1), (3, "Low", 1)]
    assert [r.customerid for r in CH.high_risk_customers(p).collect()] == ["c"]


def test_histogram_bins(spark):
    p = spark.createDataFrame([("a", 0.0), ("b", 0.02), ("c", 1.0)], PRED)
    h = {r.bin: r.customers for r in CH.risk_histogram(p).collect()}
    assert len(h) == 50 and h[0] == 1 and h[1] == 1 and h[49] == 1 and sum(h.values()) == 3


def test_features_on_literal_rows(spark):
    sales = spark.createDataFrame([
        ("o1", dt.datetime(2025, 1, 1), "a", Decimal(10), 2), ("o1", dt.datetime(2025, 1, 1), "a", Decimal(20), 1),
        ("o2", dt.datetime(2025, 6, 30), "b", Decimal(5), 4), ("o3", dt.datetime(2025, 6, 30), "ghost", Decimal(1), 1),
    ], "orderid string, timestamp timestamp_ntz, customerid string, netsale decimal(19,4), quantity int")
    cust = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), "Gold"), ("b", dt.datetime(2025, 6, 1), "Bronze"),
                                  ("nobuy", dt.datetime(2024, 1, 1), "Silver")],
                                 "customerid string, joindate timestamp_ntz, segment string")
    got = {r.customerid: r for r in CH.churn_features(sales, cust).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a.recency, a.frequency, a.monetary_value, a.avg_basket_value, a.total_quantity) == (181, 1, 30.0, 15.0, 3)
    assert (a.tenure_days, a.segment_gold, a.segment_silver, a.churn) == (547, 1, 0, 1)
    assert got["b"].churn == 0


def test_train_publish_and_evaluate_on_driver_tables(spark, tmp_path):
    t = A.DriverTables(spark, "/root/testdata/sf0.001")
    sales = enrich_sales(A.sales(t, with_part=False, with_city=False))
    store = I.TableStore(spark, str(tmp_path / "tables"))
    model, scores, test = CH.train_and_score(sales, A.customers(t), store=store)
    assert CH.ChurnModel.of(store.read(CH.MODEL_TABLE)) == CH.ChurnModel(model.features, model.means, model.stds, model.weights)
    preds = I.load_predictions(store)
    assert preds.columns == ["customerid", "churn_probability"] and preds.count() == scores.count()
    assert [tuple(r) for r in CH.risk_bands(preds).collect()][0][1] == "High"
    ev = CH.evaluation(test).first()
    assert ev.accuracy > 0.8  # the label leaks through recency, as in the reference
    conf = CH.confusion(test).collect()
    assert len(conf) == 4 and sum(r["count"] for r in conf) == test.count()
    probs = [r.churn_probability for r in scores.collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)


def made(spark, n, seed, spread=1.0):
    r = random.Random(seed)
    rows = [(f"c{i}", int(spread * r.gauss(180, 120)), r.randrange(1, 20), r.random() * 900, None if i % 17 == 0 else r.random() * 90, r.randrange(60),
             r.randrange(900), r.randrange(2), 0) for i in range(n)]
    rows = [(*row, int(row[1] > 180) if r.random() < 0.9 else r.randrange(2)) for row in rows]
    return spark.createDataFrame(rows, "customerid string, recency long, frequency long, monetary_value double, avg_basket_value double, "
                                       "total_quantity long, tenure_days long, segment_silver int, segment_gold int, churn int")


@pytest.mark.parametrize("spread", [1.0, 50.0])
def test_newton_reaches_the_minimum(spark, spread):
    """The gradient of the reference's objective, computed anew in plain numpy, vanishes; the scaler is the population's."""
    df = made(spark, 400, 1, spread)
    model = CH.fit_churn_model(df.repartition(5))
    rows = df.collect()
    x = np.array([[float(r[f] or 0) for f in CH.FEATURES] for r in rows])
    y = np.array([r.churn for r in rows])
    assert np.allclose(model.means, x.mean(axis=0)) and np.allclose(model.stds, x.std(axis=0))
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.array(model.weights)
    p = 1 / (1 + np.exp(-z @ b))
    assert np.abs(b + z.T @ (w * (p - y))).max() < 1e-7
    got = {r.customerid: r.churn_probability for r in CH.score(model, df).collect()}
    assert all(abs(got[r.customerid] - q) < 1e-9 for r, q in zip(rows, p)) and model.passes < 40
    assert len(CH.fit_churn_model(df, exclude_recency=True).weights) == len(CH.FEATURES)


def test_one_class_and_no_rows(spark):
    only = made(spark, 30, 2).withColumn("churn", F.lit(1))
    assert all(r.churn_probability > 0.5 for r in CH.score(CH.fit_churn_model(only), only).collect())
    with pytest.raises(ValueError):
        CH.fit_churn_model(only.limit(0))
    assert CH.stratified_split(only.limit(0)).bounds == {}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 333, 3000])
def test_split_takes_exactly_its_share_of_each_class(spark, n):
    df = made(spark, n, n)
    train, test = CH.split_train_test(df)
    sizes = Counter(r.churn for r in df.collect())
    assert Counter(r.churn for r in train.collect()) == Counter({c: (7 * k + 5) // 10 for c, k in sizes.items() if (7 * k + 5) // 10})
    assert train.count() + test.count() == n
    again = CH.split_train_test(df.repartition(7))[0]
    assert sorted(r.customerid for r in again.collect()) == sorted(r.customerid for r in train.collect())


def test_split_tells_equal_hashes_apart(spark, monkeypatch):
    monkeypatch.setattr(CH, "split_hash", lambda seed=0: F.pmod(F.xxhash64("customerid"), F.lit(3)) + 4)
    df = made(spark, 200, 7)
    train, _ = CH.split_train_test(df)
    sizes = Counter(r.churn for r in df.collect())
    assert Counter(r.churn for r in train.collect()) == {c: (7 * k + 5) // 10 for c, k in sizes.items()}


def test_only_changed_customers_are_rescored(spark, tmp_path):
    store, df = I.TableStore(spark, str(tmp_path / "tables")), made(spark, 100, 3)
    model = CH.fit_churn_model(df)
    CH.publish_scores(store, model, df)
    assert store.read(CH.STATE_TABLE).where("rescored").count() == 100
    versions = store.snapshots.manifest().version
    later = df.where("customerid <> 'c9'").withColumn("frequency", F.when(F.col("customerid").isin("c1", "c2"), 77).otherwise(F.col("frequency")))
    CH.rescore(store, later)
    assert store.snapshots.manifest().version == versions + 1  # model, scores and state in one step
    assert {r.customerid for r in store.read(CH.STATE_TABLE).where("rescored").collect()} == {"c1", "c2"}
    want = {r.customerid: r.churn_probability for r in CH.score(model, later).collect()}
    got = {r.customerid: r.churn_probability for r in I.load_predictions(store).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in got)
    other = CH.fit_churn_model(df, exclude_recency=True)
    CH.publish_scores(store, other, later)  # a new model scores everybody
    assert store.read(CH.STATE_TABLE).where("rescored").count() == 99


def test_empty_score_table_gives_no_rows(spark):
    p = spark.createDataFrame([], PRED)
    assert CH.risk_bands(p).count() == 0 and CH.risk_histogram(p).count() == 0
