"""Fraud model: preparation, training, scoring and evaluation (§2.11 M1–M6, §2.6 A15, A18–A21).

Preparation is exact and deterministic so that it can be checked against SQL: scaling uses the
population standard deviation of all rows; undersampling and the stratified split take the first rows of each class in the order of a
hash of (id, seed): counts by leading digits find the last hash taken, and a filter does the rest.
The forest is MLlib's ``RandomForestClassifier`` inside a ``Pipeline``; it is applied with
``model.transform`` (never a per-row UDF). Metrics are aggregates; the ROC AUC is the exact
mid-rank (Mann–Whitney) form computed with a distributed running total over the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.operators.windows import running_total

FEATURE_COUNT = 28
# Fixed values of the live feature vector: slot → value when the condition holds.
LIVE_FEATURE_SLOTS = {1: -2.5, 2: -3.0, 3: -2.8, 4: -2.2}


HASH_DIGITS = 32  # of an MD5 in hex


def feature_columns(n: int = FEATURE_COUNT) -> list[str]:
    return ["Time"] + [f"V{i}" for i in range(1, n + 1)] + ["Amount"]


def label_profile(df: DataFrame, label: str = "Class") -> DataFrame:
    """Rows, fraud rows, normal rows, fraud rate in percent."""
    y = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(y).cast("long").alias("fraud"),
                  F.count_if(y == 0).alias("normal"), (F.avg(y) * 100).alias("fraud_rate_pct"))


def scaler_stats(df: DataFrame, cols=("Amount", "Time")) -> dict:
    """Mean and population standard deviation of each column (one aggregate row)."""
    row = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols],
                 *[F.stddev_pop(c).alias(f"{c}_std") for c in cols]).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in cols}


def standardize(df: DataFrame, stats: dict) -> DataFrame:
    """M1: (x − mean) / population std with the fitted stats (sklearn's StandardScaler)."""
    out = df
    for c, (mean, std) in stats.items():
        scale = std if std else 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(mean)) / F.lit(scale))
    return out


def _hash_order(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def smallest_hashes(df: DataFrame, h: Column, k: int) -> tuple[str, int, int]:
    """The k-th smallest of the hex hashes ``h`` (k from 1 to the number of rows), how many rows hold a smaller one,
    and how many hold it. The hash is found digit by digit: counts by the next three digits (4,096 at most) name the
    bin that holds the k-th, so rows are counted but never ranked or shuffled."""
    found, below, here = "", 0, None
    while len(found) < HASH_DIGITS:
        step = min(3, HASH_DIGITS - len(found))
        rows = df.where(h.startswith(found)) if found else df
        counts = sorted((r[0], r[1]) for r in rows.groupBy(F.substring(h, len(found) + 1, step)).count().collect())
        for digits, n in counts:
            if below + n >= k:
                found, here = found + digits, n
                break
            below += n
        if here == 1:
            return df.where(h.startswith(found)).select(h).first()[0], below, 1
    return found, below, here


def smallest_rows(df: DataFrame, key: str, seed: int, k: int) -> Column:
    """Condition that exactly the ``k`` first rows of ``df`` in hash order of (id, seed) meet (all, if fewer). Rows that
    share the last id taken are told apart by all their columns; those alike in all of them go together."""
    n = df.count() if k > 0 else 0
    if k >= n or k <= 0:
        return F.lit(k > 0)
    h = _hash_order(key, seed)
    last, below, here = smallest_hashes(df, h, k)
    if below + here == k:
        return h <= last
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    edge, _, _ = smallest_hashes(df.where(h == last), whole, k - below)
    return (h < last) | ((h == last) & (whole <= edge))


def undersample(df: DataFrame, label: str = "Class", key: str = "id", ratio: int = 10, seed: int = 42) -> DataFrame:
    """M2 + U1: every fraud row plus exactly ``ratio`` × (number of fraud rows) normal rows
    (all of them when there are fewer), chosen by hash order of (id, seed)."""
    fraud, normal = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    return fraud.unionByName(normal.filter(smallest_rows(normal, key, seed, ratio * fraud.count())))


def stratified_split(df: DataFrame, label: str = "Class", key: str = "id", test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: within each class the ceil(fraction × class size) first rows in
    hash order of (id, seed) form the test part."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    is_test = F.lit(False)
    for cls, n in sizes.items():
        own = F.col(label).eqNullSafe(F.lit(cls))
        n_test = int(-(-n * test_fraction // 1))  # ceil
        is_test = is_test | (own & smallest_rows(df.where(own), key, seed, n_test))
    return df.withColumn("is_test", F.coalesce(is_test, F.lit(False)))


def class_weights(df: DataFrame, label: str = "Class", out: str = "weight") -> DataFrame:
    """Balanced weights n / (classes × n_class) as a column."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    total, k = sum(sizes.values()), len(sizes)
    w = None
    for cls, n in sizes.items():
        w = (F.when(F.col(label) == cls, F.lit(total / (k * n))) if w is None
             else w.when(F.col(label) == cls, F.lit(total / (k * n))))
    return df.withColumn(out, w)


def train_fraud_model(train: DataFrame, label: str = "Class", num_trees: int = 100, max_depth: int = 10,
                      seed: int = 42, weight_col: str | None = "weight"):
    """M3: assemble the 30 features and fit a random forest (100 trees, depth 10)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    assembler = VectorAssembler(inputCols=feature_columns(), outputCol="features")
    params = dict(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth, seed=seed)
    if weight_col:
        params["weightCol"] = weight_col
    forest = RandomForestClassifier(**params)
    return Pipeline(stages=[assembler, forest]).fit(train)


def score_test(model, df: DataFrame) -> DataFrame:
    """M4: predicted class and fraud probability."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.withColumn("p_fraud", vector_to_array(F.col("probability"))[1]) \
        .withColumn("prediction", F.col("prediction").cast("int"))


def live_features(orders: DataFrame, stats: dict, ts: str = "ts", keep: list | None = None) -> DataFrame:
    """M5: the detector's 30-slot vector per order: scaled hour-of-day seconds, 28 zeros with
    slots 1–4 set for new customer / velocity > 3 / failed > 2 / amount > 1000, scaled amount."""
    t_mean, t_std = stats["Time"]
    a_mean, a_std = stats["Amount"]
    conds = {1: F.coalesce(F.col("is_new_customer"), F.lit(True)),
             2: F.coalesce(F.col("orders_last_hour"), F.lit(0)) > 3,
             3: F.coalesce(F.col("failed_attempts"), F.lit(0)) > 2,
             4: F.coalesce(F.col("amount"), F.lit(0.0)) > 1000}
    slots = [((F.hour(F.col(ts)) * 3600 - F.lit(t_mean)) / F.lit(t_std or 1.0)).cast("double").alias("Time")]
    for i in range(1, FEATURE_COUNT + 1):
        v = F.when(conds[i], F.lit(LIVE_FEATURE_SLOTS[i])).otherwise(F.lit(0.0)) if i in conds else F.lit(0.0)
        slots.append(v.alias(f"V{i}"))
    slots.append(((F.coalesce(F.col("amount"), F.lit(0.0)) - F.lit(a_mean)) / F.lit(a_std or 1.0)).alias("Amount"))
    return orders.select(*(keep or ["order_id"]), *slots)


def _live_scores(orders: DataFrame, model, stats: dict, ts: str, keep: list) -> DataFrame:
    """``keep`` and ``ml_score`` = trunc(100 · p(fraud)); a row the model cannot score, as it has no time, gets 0."""
    slots = live_features(orders, stats, ts, keep=keep).withColumn("_usable", F.col("Time").isNotNull()).na.fill(0.0, ["Time"])
    score = F.when(F.col("_usable"), (F.col("p_fraud") * 100).cast("int"))
    return score_test(model, slots).withColumn("ml_score", F.coalesce(score, F.lit(0)))


def ml_score(orders: DataFrame, model, stats: dict, key: str = "order_id", ts: str = "ts") -> DataFrame:
    """M6: (key, ml_score)."""
    return _live_scores(orders, model, stats, ts, [key]).select(key, "ml_score")


def with_ml_score(orders: DataFrame, model, stats: dict, ts: str = "ts") -> DataFrame:
    """M6 in one pass: ``orders`` with ``ml_score``; the orders travel as one struct beside their features, so nothing
    is joined back and repeated ids keep their own scores."""
    kept = F.struct(*[F.col(c) for c in orders.columns if c != "ml_score"])
    return _live_scores(orders, model, stats, ts, [kept.alias("_order")]).select("_order.*", "ml_score")


def confusion_matrix(pred: DataFrame, label: str = "Class", prediction: str = "prediction") -> DataFrame:
    """Tn, fp, fn, tp."""
    y, p = F.col(label), F.col(prediction)
    return pred.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                    F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def accuracy(cm: DataFrame) -> DataFrame:
    """(tn + tp) / n × 100."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cm.select((F.col("tn") + F.col("tp")) / n * 100).toDF("accuracy_pct")


def classification_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def stats(tp_, fp_, fn_):
        prec = F.when(tp_ + fp_ > 0, tp_ / (tp_ + fp_)).otherwise(F.lit(0.0))
        rec = F.when(tp_ + fn_ > 0, tp_ / (tp_ + fn_)).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        return prec, rec, f1

    p0, r0, f0 = stats(tn, fn, fp)  # class 0 seen as the positive class
    p1, r1, f1 = stats(tp, fp, fn)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("Normal").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"),
                 s0.alias("support")),
        F.struct(F.lit("Fraud").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"),
                 s1.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f0 * s0 + f1 * s1) / n).alias("f1"),
                 n.alias("support")))
    return cm.select(F.explode(rows).alias("r")).select("r.*")


def roc_auc(pred: DataFrame, label: str = "Class", score: str = "p_fraud") -> DataFrame:
    """Exact ROC AUC = P(score_pos > score_neg) + ½ P(equal), by mid-ranks.

    Scores are aggregated to (score, positives, negatives) first; a distributed running total of
    negatives gives, per score, the negatives strictly below it."""
    per = pred.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(label)).cast("double").alias("_p"),
                                                     F.sum(1 - F.col(label)).cast("double").alias("_n"))
    below = running_total(per, [F.col("_s")], "_n", out="_nb", inclusive=False)
    return below.agg(((F.sum(F.col("_p") * (F.col("_nb") + F.col("_n") / 2)))
                      / (F.sum("_p") * F.sum("_n"))).alias("auc"))
