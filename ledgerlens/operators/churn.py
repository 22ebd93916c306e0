"""Churn modelling with Spark aggregates: features (P1-P5), exact stratified split (P6), scaled balanced logistic
regression (P7, P8), evaluation (P9), published scores (P10) and the risk views over a score table (P11, P12, K10).

Notes on parity with the reference (a scikit-learn script):
- The label is ``recency > 180`` while ``recency`` is also a feature, so the model leaks by construction. Kept for
  parity; ``exclude_recency=True`` trains without it.
- The split takes 70 % of each class, to the nearest customer: those with the smallest hashes of id and class. It is
  stable across runs, cluster sizes and engines; membership cannot equal scikit-learn's shuffle.
- A missing measure (a basket without net sales, a customer without a join date) counts as 0 in training and
  scoring; no row is dropped.
- The objective is that of the reference's solver: C = 1, balanced class weights, population standard deviations,
  and an intercept that is penalised like a coefficient. It has one minimum, which Newton steps reach to the last
  digits, so the model can be checked against any other solver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import guarded_ratio, safe_division, whole_days
from .customers import as_of_column, order_rollup

# Feature order, label threshold, split, risk bands.
FEATURES = ["recency", "frequency", "monetary_value", "avg_basket_value", "total_quantity", "tenure_days",
            "segment_silver", "segment_gold"]
CHURN_DAYS = 180
TRAIN_SHARE = 7  # tenths of each class
SEED = 42
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
HIST_BINS = 50


def churn_features(sales: DataFrame, customers: DataFrame, snapshot=None) -> DataFrame:
    """One row per customer that has sales *and* a customer record.

    RFM and basket features come from a single per-customer aggregate over
    the per-order rollup (the reference joins two aggregates of the same
    grouping; the result is the same). ``snapshot`` defaults to the latest
    sale + 1 day, evaluated as a scalar subquery.
    """
    snap = as_of_column(sales, snapshot)
    per_cust = order_rollup(sales).groupBy("customerid").agg(
        F.max("last_ts").alias("_last"),
        F.count("orderid").cast("bigint").alias("frequency"),
        F.coalesce(F.sum("net"), F.lit(0).cast("decimal(38,4)")).alias("_money"),
        F.sum("net").alias("_net"),
        F.sum("net_n").alias("_net_n"),
        F.coalesce(F.sum("qty"), F.lit(0)).cast("bigint").alias("total_quantity"),
    )
    cust = customers.select("customerid", "joindate", "segment")
    j = per_cust.join(cust, "customerid", "inner")
    recency = whole_days(F.col("_last"), snap)
    return j.select(
        "customerid",
        recency.alias("recency"),
        "frequency",
        F.col("_money").cast("double").alias("monetary_value"),
        (F.col("_net").cast("double") / F.when(F.col("_net_n") > 0, F.col("_net_n").cast("double")))
        .alias("avg_basket_value"),
        "total_quantity",
        whole_days(F.col("joindate"), snap).alias("tenure_days"),
        F.coalesce((F.col("segment") == "Silver").cast("int"), F.lit(0)).alias("segment_silver"),
        F.coalesce((F.col("segment") == "Gold").cast("int"), F.lit(0)).alias("segment_gold"),
        (recency > CHURN_DAYS).cast("int").alias("churn"),
    )


def checkpointed(features: DataFrame) -> DataFrame:
    """Cut the lineage of the feature table before training: a reliable
    checkpoint in ``spark.checkpoint.dir`` (the shared folder; set up by
    ``session.shared_dir`` only when the session has none). The fit, the test
    scoring and the full scoring then read the same files instead of
    re-running the aggregation, and a lost executor re-reads files rather
    than recomputing from the fact scan."""
    from ..session import shared_dir

    shared_dir(features.sparkSession)
    return features.checkpoint(eager=True)


HASH_DIGITS = 15  # hex digits of the hash that orders a class
STEP_DIGITS = 3  # of them told apart by one histogram


def split_hash(seed: int = SEED) -> Column:
    """The number that orders the customers of a class, from an MD5 of id, seed and class."""
    name = F.concat_ws("|", F.col("customerid").cast("string"), F.lit(str(seed)), F.col("churn").cast("string"))
    return F.conv(F.substring(F.md5(name), 1, HASH_DIGITS), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Split:
    """Of each class, the rows up to a bound (hash, customer id) are for training."""

    bounds: dict  # class -> (hash, customer id), or None where no row is taken
    seed: int = SEED

    def in_training(self) -> Column:
        out = F.lit(False)
        for label, bound in self.bounds.items():
            if bound is not None:
                h = split_hash(self.seed)
                out = out | ((F.col("churn") == label) & ((h < bound[0]) | ((h == bound[0]) & (F.col("customerid") <= F.lit(bound[1])))))
        return out

    def parts(self, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        return features.where(self.in_training()), features.where(~self.in_training())


def stratified_split(features: DataFrame, train_share: int = TRAIN_SHARE, seed: int = SEED) -> Split:
    """The bound below which exactly ``train_share`` tenths of each class lie (to the nearest customer).

    The k-th smallest hash of every class is found by refined histograms: each pass counts the rows below every
    value of the next digits, for the one range that still holds the k-th, so a pass sends at most 4096 counts a class and
    nothing is sorted. Passes end when a range holds a single row. Rows that share a whole hash are told
    apart by the customer id (a handful, collected)."""
    hashed = features.select("customerid", "churn", split_hash(seed).alias("_h"))
    sizes = {r["churn"]: r["n"] for r in hashed.groupBy("churn").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {c: (n * train_share + 5) // 10 for c, n in sizes.items()}
    bounds = {c: None for c, k in ranks.items() if k == 0}
    search = {c: (0, k) for c, k in ranks.items() if k > 0}  # class -> (digits so far, rank within that range)
    for used in range(0, HASH_DIGITS, STEP_DIGITS):
        if not search:
            break
        rest = 16 ** (HASH_DIGITS - used - STEP_DIGITS)
        inside = F.lit(False)
        for c, (prefix, _) in search.items():
            inside = inside | ((F.col("churn") == c) & (F.expr(f"_h div {rest * 16**STEP_DIGITS}") == prefix)) if used else inside | (F.col("churn") == c)
        cells = hashed.where(inside).groupBy("churn", F.expr(f"_h div {rest}").alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_h").alias("low")).collect()
        for c, (_, k) in list(search.items()):
            for r in sorted((r for r in cells if r["churn"] == c), key=lambda r: r["cell"]):
                if k <= r["n"]:
                    break
                k -= r["n"]
            search[c] = (r["cell"], k)
            if r["n"] == 1 or rest == 1:
                ids = hashed.where((F.col("churn") == c) & (F.col("_h") == r["low"])).select("customerid").orderBy("customerid").limit(k).collect()
                bounds[c] = (r["low"], ids[-1]["customerid"])
                del search[c]
    return Split(bounds, seed)


def split_train_test(features: DataFrame, train_share: int = TRAIN_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    return stratified_split(features, train_share, seed).parts(features)


def split_counts(features: DataFrame) -> DataFrame:
    """Customers per label and part (``train``, ``test``)."""
    part = F.when(stratified_split(features).in_training(), F.lit("train")).otherwise(F.lit("test"))
    return features.groupBy("churn", part.alias("part")).agg(F.count(F.lit(1)).cast("bigint").alias("customers"))


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` as a per-label frame (<= 2 rows)."""
    counts = train.groupBy("churn").agg(F.count(F.lit(1)).alias("_nc"))
    total = train.agg(F.count(F.lit(1))).scalar()
    return counts.select("churn", (total.cast("double") / (F.lit(2.0) * F.col("_nc"))).alias("class_weight"))


def filled(features: DataFrame) -> DataFrame:
    """Features without nulls, as the model reads them."""
    return features.fillna(0.0, subset=FEATURES)


@dataclass(frozen=True)
class ChurnModel:
    """P7 + P8: scaler and coefficients; scoring is an expression over the features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    weights: tuple[float, ...]  # intercept first
    passes: int = 0  # over the training rows

    def scaled(self) -> list[Column]:
        """(value - mean) / standard deviation; a constant feature is only centred."""
        return [(F.col(f).cast("double") - F.lit(m)) / F.lit(s or 1.0) for f, m, s in zip(self.features, self.means, self.stds)]

    def probability(self) -> Column:
        return _sigmoid(_linear(self.scaled(), self.weights))

    @property
    def model_id(self) -> str:
        import hashlib

        return hashlib.sha1(repr((self.features, self.means, self.stds, self.weights)).encode()).hexdigest()[:16]

    def frame(self, spark) -> DataFrame:
        """One row a feature, the intercept as a feature without scaling."""
        rows = [(self.model_id, i, f, m, s, w) for i, (f, m, s, w) in enumerate(
            zip(("intercept", *self.features), (None, *self.means), (None, *self.stds), self.weights))]
        return spark.createDataFrame(rows, "model_id string, position int, feature string, mean double, std double, weight double")

    @classmethod
    def of(cls, frame: DataFrame) -> "ChurnModel":
        rows = sorted(frame.collect(), key=lambda r: r["position"])  # one a feature
        own = rows[1:]
        return cls(tuple(r["feature"] for r in own), tuple(r["mean"] for r in own), tuple(r["std"] for r in own),
                   tuple(r["weight"] for r in rows))


def _linear(columns: list[Column], weights) -> Column:
    out = F.lit(float(weights[0]))
    for c, w in zip(columns, weights[1:]):
        out = out + c * F.lit(float(w))
    return out


def _sigmoid(z: Column) -> Column:
    # exp of a negative number only, so nothing overflows
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def fit_churn_model(train: DataFrame, exclude_recency: bool = False, tolerance: float = 1e-10, most_passes: int = 100) -> ChurnModel:
    """P7 + P8: the minimum of ``|b|^2 / 2 + sum w_i log(1 + exp(-y_i b.x_i))`` by Newton steps.

    A pass is one aggregate over the training rows: the loss, its gradient and its second derivatives, 55 sums for 8
    features however many rows. A step that does not lower the loss is halved."""
    feats = tuple(f for f in FEATURES if not (exclude_recency and f == "recency"))
    rows = filled(train)
    one = rows.agg(*[F.count_if(F.col("churn") == c).alias(f"n{c}") for c in (0, 1)],
                   *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in feats for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = one["n0"] + one["n1"]
    if n == 0:
        raise ValueError("no training rows")
    scaler = ChurnModel(feats, tuple(one[f"m_{c}"] for c in feats), tuple(one[f"s_{c}"] for c in feats), ())
    weight = F.when(F.col("churn") == 1, F.lit(n / (2.0 * max(1, one["n1"])))).otherwise(F.lit(n / (2.0 * max(1, one["n0"]))))
    data = rows.select(F.col("churn").cast("double").alias("y"), weight.alias("w"), F.lit(1.0).alias("x0"),
                       *[c.alias(f"x{i + 1}") for i, c in enumerate(scaler.scaled())])
    k = len(feats) + 1
    xs = [F.col(f"x{i}") for i in range(k)]

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = _linear(xs[1:], b)
        step = data.select("*", z.alias("z")).select("*", _sigmoid(F.col("z")).alias("p"))
        step = step.select("*", (F.col("w") * (F.col("p") - F.col("y"))).alias("r"), (F.col("w") * F.col("p") * (1.0 - F.col("p"))).alias("v"))
        # log(1 + exp(-s)) for the signed distance s, without overflow
        s = F.when(F.col("y") == 1.0, F.col("z")).otherwise(-F.col("z"))
        loss = F.col("w") * (F.log1p(F.exp(-F.abs(s))) + F.greatest(-s, F.lit(0.0)))
        got = step.agg(F.sum(loss).alias("loss"), *[F.sum(F.col("r") * xs[i]).alias(f"g{i}") for i in range(k)],
                       *[F.sum(F.col("v") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        h = np.eye(k)
        for i in range(k):
            for j in range(i, k):
                h[i, j] += got[f"h{i}_{j}"]
                h[j, i] = h[i, j]
        return got["loss"] + b @ b / 2, np.array([got[f"g{i}"] for i in range(k)]) + b, h

    b = np.zeros(k)
    loss, g, h = at(b)
    passes = 1
    while passes < most_passes:
        step = np.linalg.solve(h, g)
        if np.abs(step).max() < tolerance:
            break
        after, loss_after = None, np.inf
        while passes < most_passes and np.abs(step).max() >= tolerance:
            after = at(b - step)
            passes += 1
            loss_after = after[0]
            if loss_after <= loss * (1 + 1e-12):
                break
            step = step / 2
        if after is None or loss_after > loss * (1 + 1e-12):
            break
        b, (loss, g, h) = b - step, after
    return ChurnModel(feats, scaler.means, scaler.stds, tuple(map(float, b)), passes)


def scaler_stats(model: ChurnModel, spark) -> DataFrame:
    """Mean and standard deviation of every feature, as the fitted scaler holds them."""
    return model.frame(spark).where("position > 0").select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def score(model: ChurnModel, features: DataFrame) -> DataFrame:
    """P10: ``customerid``, predicted class and churn probability."""
    rows = filled(features).select("customerid", "churn", model.probability().alias("churn_probability"))
    return rows.select("customerid", "churn", (F.col("churn_probability") > 0.5).cast("int").alias("prediction"), "churn_probability")


def confusion(scored: DataFrame) -> DataFrame:
    """The 2x2 confusion matrix as (label, prediction, count), all four cells."""
    agg = scored.agg(*[F.count_if((F.col("churn") == a) & (F.col("prediction") == b)).cast("bigint").alias(f"_{a}{b}")
                       for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"_{a}{b}").alias("count"))
                      for a in (0, 1) for b in (0, 1)])
    return agg.select(F.inline(cells))


def evaluation(scored: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support, plus overall accuracy."""
    agg = scored.agg(*[F.count_if((F.col("churn") == a) & (F.col("prediction") == b)).alias(f"c{a}{b}")
                       for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        other = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{other}{k}"), F.col(f"c{k}{other}")
        precision = safe_division(tp, tp + fp)
        recall = safe_division(tp, tp + fn)
        f1 = safe_division(F.lit(2.0) * precision * recall, precision + recall)
        rows.append(F.struct(F.lit(k).alias("label"), precision.alias("precision"), recall.alias("recall"),
                             f1.alias("f1"), (tp + fn).cast("bigint").alias("support")))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    return agg.select(guarded_ratio(F.col("c00") + F.col("c11"), total).alias("accuracy"),
                      F.inline(F.array(*rows)))


MODEL_TABLE = "churn_model"
STATE_TABLE = "churn_score_state"


def feature_digest(features: tuple[str, ...] | list[str] = tuple(FEATURES)) -> Column:
    """Identity of a customer's features."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in features]))


def publish_scores(store, model: ChurnModel, features: DataFrame) -> None:
    """P10: model, score table and what each score was made from, in one snapshot of the store: readers see the scores
    of one model, never of two.

    A customer whose features and model are those of the published score keeps it; the others are scored."""
    from ..sources.schemas import PREDICTIONS_TABLE

    spark = store.spark
    rows = filled(features).withColumn("_id", F.col("customerid").cast("string")).withColumn("_digest", feature_digest(model.features))
    fresh = model.probability()
    if store.exists(STATE_TABLE) and store.exists(PREDICTIONS_TABLE):
        old = (store.read(STATE_TABLE).where(F.col("model_id") == model.model_id)
               .select(F.col("customerid").alias("_id"), F.col("feature_digest").alias("_old")).join(
                   store.read(PREDICTIONS_TABLE).select(F.col("customerid").alias("_id"), F.col("churn_probability").alias("_known")), "_id"))
        rows = rows.join(old, "_id", "left")
        same = F.col("_old").eqNullSafe(F.col("_digest"))
        rows = rows.select("_id", "_digest", F.when(same, F.col("_known")).otherwise(fresh).alias("_p"), (~same).alias("_changed"))
    else:
        rows = rows.select("_id", "_digest", fresh.alias("_p"), F.lit(True).alias("_changed"))
    scored = checkpointed(rows)
    store.together({
        MODEL_TABLE: model.frame(spark),
        PREDICTIONS_TABLE: scored.select(F.col("_id").alias("customerid"), F.col("_p").alias("churn_probability")),
        STATE_TABLE: scored.select(F.col("_id").alias("customerid"), F.col("_digest").alias("feature_digest"),
                                   F.lit(model.model_id).alias("model_id"), F.col("_changed").alias("rescored"))}, "overwrite")


def rescore(store, features: DataFrame) -> ChurnModel:
    """P10: new features against the published model."""
    model = ChurnModel.of(store.read(MODEL_TABLE))
    publish_scores(store, model, features)
    return model


def train_and_score(sales: DataFrame, customers: DataFrame, snapshot=None, exclude_recency: bool = False, store=None):
    """P1-P10 end to end. Returns (model, scores for every customer, test-set scores).

    ``store`` (a ``sources.ingest.TableStore``) receives the model and the scores; the risk views read them back (S12)."""
    feats = checkpointed(churn_features(sales, customers, snapshot))
    train, test = split_train_test(feats)
    model = fit_churn_model(train, exclude_recency)
    if store is not None:
        publish_scores(store, model, feats)
    return model, score(model, feats), score(model, test)


def risk_bands(predictions: DataFrame) -> DataFrame:
    """High (> 0.7), Medium (0.4, 0.7], Low (<= 0.4); null is in no band;
    every band listed, 0 when empty; an empty score table -> no rows."""
    p = F.col("churn_probability")
    agg = predictions.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(p > HIGH_RISK).cast("bigint").alias("_h"),
        F.count_if((p > MEDIUM_RISK) & (p <= HIGH_RISK)).cast("bigint").alias("_m"),
        F.count_if(p <= MEDIUM_RISK).cast("bigint").alias("_l"),
    ).where(F.col("_rows") > 0)
    bands = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("High").alias("band"), F.col("_h").alias("customers")),
        F.struct(F.lit(2).alias("position"), F.lit("Medium").alias("band"), F.col("_m").alias("customers")),
        F.struct(F.lit(3).alias("position"), F.lit("Low").alias("band"), F.col("_l").alias("customers")),
    )
    return agg.select(F.inline(bands))


def risk_histogram(predictions: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Fixed-width histogram of probabilities on [0, 1]; 1.0 falls in the
    last bin; every bin listed, 0 when empty; no scores -> no rows.

    One ``groupBy(bin).count()`` (partial aggregation, at most ``bins``
    groups); the <= ``bins`` counts are then folded into one map and expanded
    over ``sequence(0, bins - 1)`` to zero-fill - bounded by the bin count,
    not by the data, and no join.
    """
    p = F.col("churn_probability")
    b = F.least(F.greatest(F.floor(p * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = predictions.where(p.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    table = (counts.agg(F.count(F.lit(1)).alias("_bins"),
                        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
             .where(F.col("_bins") > 0))
    cells = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(
        i.alias("bin"),
        (i.cast("double") / F.lit(float(bins))).alias("bin_start"),
        ((i + 1).cast("double") / F.lit(float(bins))).alias("bin_end"),
        F.coalesce(F.col("m")[i], F.lit(0)).cast("bigint").alias("customers")))
    return table.select(F.inline(cells))


def high_risk_customers(predictions: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    """Customers whose churn probability is above the threshold."""
    return predictions.where(F.col("churn_probability") > threshold)
