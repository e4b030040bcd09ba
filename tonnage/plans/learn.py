"""Task models on pyspark.ml: preprocessing, baselines, boosted trees, intervals, calibration, scoring.

Every fit and transform is a distributed job; only fitted parameters (coefficients, trees, a few statistics)
reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tonnage.functions.scalar import hash_id
from tonnage.operators.lookup import apply_conditioned, conditioned_stat, global_stat
from tonnage.operators.ordered import exact_quantiles
from tonnage.plans import metrics
from tonnage.plans.contracts import PATIENCE, Task
from tonnage.plans.splits import expanding_folds, task_rows
from tonnage.sources.scratch import scratch, written

SEED = 7


@dataclass(frozen=True)
class Features:
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]

    @property
    def all(self) -> tuple[str, ...]:
        return self.categorical + self.numeric


@dataclass
class Preprocessor:
    modes: dict[str, str]
    pipeline: PipelineModel
    features: Features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(_typed(df, self.features).fillna(self.modes))


def _typed(df: DataFrame, features: Features) -> DataFrame:
    casts = {c: F.col(c).cast("string") for c in features.categorical} | {c: F.col(c).cast("double") for c in features.numeric}
    return df.withColumns(casts)


def fit_preprocessor(train: DataFrame, features: Features, scale: bool = False, one_hot: bool = True) -> Preprocessor:
    """Mode / median imputation, category encoding with unknowns kept apart, optional scaling: train rows only."""
    typed = _typed(train, features)
    modes = {}
    if features.categorical:
        row = typed.agg(*[F.mode(c, deterministic=True).alias(c) for c in features.categorical]).first()
        modes = {c: row[c] for c in features.categorical if row[c] is not None}
    stages, parts = [], []
    if features.categorical:
        codes = [f"__{c}_code" for c in features.categorical]
        stages.append(StringIndexer(inputCols=list(features.categorical), outputCols=codes, handleInvalid="keep"))
        if one_hot:
            hot = [f"__{c}_hot" for c in features.categorical]
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"))
            parts += hot
        else:
            parts += codes
    if features.numeric:
        filled = [f"__{c}_num" for c in features.numeric]
        stages.append(Imputer(strategy="median", inputCols=list(features.numeric), outputCols=filled))
        if scale:
            stages.append(VectorAssembler(inputCols=filled, outputCol="__raw"))
            stages.append(StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True))
            parts.append("__scaled")
        else:
            parts += filled
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Preprocessor(modes, Pipeline(stages=stages).fit(typed.fillna(modes)), features)


def _bins(train: DataFrame) -> int:
    """Split candidates: at least one for each value of the widest category, as the encoded features declare it."""
    attributes = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return max([32, *(len(a.get("vals", ())) for a in attributes.get("nominal", ()))])


def ridge(train: DataFrame, alpha: float = 10.0):
    """Squared loss plus alpha * |w|^2; Spark averages the loss, so the penalty is divided by the row count."""
    n = train.count()
    return LinearRegression(labelCol="label", elasticNetParam=0.0, regParam=alpha / max(n, 1), standardization=False).fit(train)


def balanced(df: DataFrame) -> DataFrame:
    """Class weights inverse to frequency: n / (2 * n_class)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, p = row["n"], row["p"] or 0.0
    weight = F.when(F.col("label") == 1.0, n / max(2.0 * p, 1.0)).otherwise(n / max(2.0 * (n - p), 1.0))
    return df.withColumn("weight", weight.cast("double"))


def _stored(model, name: str):
    """The model read back from shared storage: coefficients and trees only. A fitted classifier also holds the summary of its
    training, with the training frame behind it, and its scoring function would carry all of that to the tasks."""
    path = f"{scratch(SparkSession.active())}/{name}"
    model.write().save(path)
    return type(model).load(path)


def logistic(train: DataFrame, c: float = 0.5):
    n = train.count()
    model = LogisticRegression(labelCol="label", weightCol="weight", elasticNetParam=0.0, regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=500)
    return _stored(model.fit(balanced(train)), "logistic")


def forest(train: DataFrame, kind: str, trees: int = 60, depth: int = 12, leaf: int = 10):
    common = dict(labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=_bins(train), seed=SEED)
    if kind == "regression":
        return RandomForestRegressor(**common).fit(train)
    return _stored(RandomForestClassifier(weightCol="weight", **common).fit(balanced(train)), "forest")


def best_round(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """The round (from 1) to keep of the tuning errors after each round, and whether training stops there: a round counts until `patience` rounds bring no
    lower error. Without tuning rows no error is known and all rounds are kept."""
    best = len(errors) if math.isnan(errors[0]) else 1
    for i, e in enumerate(errors, 1):
        if e < errors[best - 1]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def boosted(task: Task, train: DataFrame, tune: DataFrame, rounds: int | None = None, depth: int | None = None):
    """Boosted trees with the rounds and depth of the task, cut to the round that is best on the tuning split, with patience.

    Spark's own stop has no patience, so rounds are trained without it, first a few, then all; trees are the same however many follow. With `rounds`
    it is a short run of at most so many, under Spark's own stop."""
    both = train.withColumn("__tuning", F.lit(False)).unionByName(tune.withColumn("__tuning", F.lit(True)))
    common = dict(labelCol="label", maxDepth=depth or task.depth, stepSize=task.rate, maxBins=_bins(both), seed=SEED)
    make = partial(GBTRegressor, lossType=task.loss, **common) if task.kind == "regression" else partial(GBTClassifier, **common)
    if rounds:
        return make(maxIter=rounds, validationIndicatorCol="__tuning").fit(both)
    for size in sorted({min(PATIENCE + PATIENCE // 2, task.rounds), task.rounds}):
        model = make(maxIter=size).fit(train)
        errors = model.evaluateEachIteration(tune, "absolute") if task.kind == "regression" else model.evaluateEachIteration(tune)
        best, stopped = best_round(errors)
        if stopped:
            break
    return model if best == size else make(maxIter=best).fit(train)


def with_score(model, df: DataFrame, kind: str) -> DataFrame:
    """Regression: `prediction`. Classification: raw margin in `score` and probability in `prediction`."""
    out = model.transform(df)
    if kind == "regression":
        return out
    return out.drop("prediction").withColumn("score", vector_to_array("rawPrediction")[1]).withColumn("prediction", vector_to_array("probability")[1])


def conformal_quantiles(calibration: DataFrame, by: Sequence[str] = (), min_rows: int = 30) -> DataFrame:
    """Residual quantiles of the calibration split per segment; thin segments are left to the global row."""
    residuals = calibration.withColumn("__res", F.col("label") - F.col("prediction"))
    wanted = {"r10": 0.1, "r50": 0.5, "r90": 0.9}
    if not by:
        return exact_quantiles(residuals, [], "__res", wanted)
    thick = residuals.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows).drop("__n")
    return exact_quantiles(residuals, by, "__res", wanted).join(thick, list(by), "left_semi")


def apply_quantiles(scored: DataFrame, overall: DataFrame, segments: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """p10 <= p50 <= p90 around the point prediction."""
    names = ("r10", "r50", "r90")
    base = {n: overall.select(n).scalar() for n in names}
    if segments is not None:
        scored = scored.join(segments, list(by), "left")
        offsets = [F.coalesce(F.col(n), base[n]) for n in names]
    else:
        offsets = [base[n] for n in names]
    ordered = F.sort_array(F.array(*[F.col("prediction") + o for o in offsets]))
    out = scored.withColumn("__q", ordered)
    return out.withColumns({"p10": F.col("__q")[0], "p50": F.col("__q")[1], "p90": F.col("__q")[2]}).drop("__q", *(names if segments is not None else ()))


def platt(calibration: DataFrame) -> LogisticRegressionModel:
    """Sigmoid of a*score + b, fitted on calibration rows."""
    vector = VectorAssembler(inputCols=["score"], outputCol="__score")
    return LogisticRegression(labelCol="label", featuresCol="__score", regParam=0.0).fit(vector.transform(calibration.select("label", "score")))


def calibrate(scored: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    a, b = float(model.coefficients[0]), float(model.intercept)
    return scored.withColumn("calibrated_probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("score") + F.lit(b)))))


@dataclass
class Fitted:
    task: Task
    preprocessor: Preprocessor
    model: object
    overall: DataFrame | None = None
    sigmoid: LogisticRegressionModel | None = None

    def score(self, df: DataFrame) -> DataFrame:
        out = with_score(self.model, self.preprocessor.transform(df), self.task.kind)
        if self.overall is not None:
            out = apply_quantiles(out, self.overall)
        return calibrate(out, self.sigmoid) if self.sigmoid is not None else out


def fit(task: Task, data: DataFrame, features: Features, rounds: int | None = None, depth: int | None = None) -> Fitted:
    """Train on `train`, stop on `tuning`, fit intervals or calibration on `calibration`."""
    train, tune, cal = (task_rows(data, task, s) for s in ("train", "tuning", "calibration"))
    prep = fit_preprocessor(train, features, one_hot=False)
    model = boosted(task, prep.transform(train), prep.transform(tune), rounds, depth)
    held = with_score(model, prep.transform(cal), task.kind)
    if task.kind == "regression":
        return Fitted(task, prep, model, overall=conformal_quantiles(held) if task.quantiles else None)
    return Fitted(task, prep, model, sigmoid=platt(held))


def prediction_rows(fitted: Fitted, data: DataFrame, key: str = "sample_key", version: str = "1") -> DataFrame:
    """Frozen-model scores as rows of the prediction contract plus the observed label."""
    scored = fitted.score(data)
    blank = F.lit(None).cast("double")
    present = set(scored.columns)
    return scored.select(
        hash_id("PRED", [F.lit(fitted.task.name), F.col(key)]).alias("prediction_id"),
        F.col(key).cast("string").alias("entity_id"),
        F.col("snapshot_ts").alias("prediction_time_ts"),
        F.lit(fitted.task.name).alias("target_name"),
        *[(F.col(c) if c in present else blank).alias(c) for c in ("p10", "p50", "p90", "calibrated_probability")],
        F.lit(version).alias("model_version"),
        F.col(fitted.task.target).cast("double").alias("observed"),
        "prediction",
    )


def baseline_rows(task: Task, train: DataFrame, test: DataFrame, by: Sequence[str]) -> dict[str, DataFrame]:
    """Global and conditioned baselines, scored on `test`."""
    stat, kind = ("median", "median") if task.kind == "regression" else ("mean", "rate")
    overall = global_stat(train, "label", stat).scalar()
    stats = conditioned_stat(train, "label", by, kind)
    return {
        "global": test.withColumn("prediction", overall),
        "conditioned": apply_conditioned(test, stats, by, overall).withColumnRenamed("estimate", "prediction"),
    }


def task_metrics(task: Task, scored: DataFrame, key: str = "sample_key") -> DataFrame:
    """Long metric rows (task, model, metric, value); `scored` carries a `model` column, so all models share the jobs."""
    if task.kind == "regression":
        wide = metrics.regression_metrics(scored, "label", "prediction", ["model"])
    else:
        wide = metrics.classification_metrics(scored, "label", "prediction", key, ["model"])
    names = [c for c in wide.columns if c != "model"]
    long = wide.select("model", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("model", names, "metric", "value")
    return long.select(F.lit(task.name).alias("task"), "model", "metric", "value")


def run_tasks(
    tasks: Sequence[Task], frames: Mapping[str, DataFrame], features: Mapping[str, Features], by: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Fit each task on its snapshot as its contract says, and evaluate it; boosted trees and baselines on the final-test rows.

    Snapshots train side by side, the tasks of one snapshot one after the other, so that each caches the rows of one task."""
    def fit_all(snapshot: str) -> dict[str, Fitted]:
        return {t.name: fit(t, frames[snapshot], features[snapshot]) for t in tasks if t.snapshot == snapshot}

    inherit = inheritable_thread_target(next(iter(frames.values())).sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        fits = {name: f for part in pool.map(inherit(fit_all), frames) for name, f in part.items()}
    out = None
    for task in tasks:
        data = frames[task.snapshot]
        train, test = task_rows(data, task, "train"), task_rows(data, task, "final_test")
        main = fits[task.name].score(test)
        if task.kind == "classification":
            main = main.drop("prediction").withColumnRenamed("calibrated_probability", "prediction")
        models = {"boosted": main, **baseline_rows(task, train, test, by[task.snapshot])}
        scored = None
        for name, df in models.items():
            rows = df.select("sample_key", "label", F.col("prediction").cast("double").alias("prediction"), F.lit(name).alias("model"))
            scored = rows if scored is None else scored.unionByName(rows)
        # a few rows, written so that the shuffle files of a task go before the next one starts
        result = written(task_metrics(task, written(scored, task.name)), "metrics")
        out = result if out is None else out.unionByName(result)
    return out


def backtest_runs(task: Task, data: DataFrame, features: Features, folds: int = 3, rounds: int | None = None, depth: int | None = None) -> DataFrame:
    """One row per expanding fold: row counts, window borders and the validation metric."""
    eligible = task_rows(data, task)
    roles = expanding_folds(eligible, "snapshot_ts", "target_available_at_ts", "sample_key", folds)
    out = None
    for fold in range(1, folds + 1):
        mine = eligible.join(roles.filter(F.col("fold") == fold).drop("fold"), "sample_key")
        train, check = mine.filter("role = 'train'").drop("role"), mine.filter("role = 'validation'").drop("role")
        prep = fit_preprocessor(train, features, one_hot=False)
        model = boosted(task, prep.transform(train), prep.transform(check), rounds, depth)
        scored = with_score(model, prep.transform(check), task.kind)
        value = metrics.regression_metrics(scored, "label", "prediction").select("mae") if task.kind == "regression" else metrics.pr_auc(scored, "label", "prediction")
        borders = mine.agg(
            F.count_if(F.col("role") == "train").alias("train_rows"),
            F.count_if(F.col("role") == "validation").alias("validation_rows"),
            F.max(F.when(F.col("role") == "train", F.col("snapshot_ts"))).alias("train_end"),
            F.min(F.when(F.col("role") == "validation", F.col("snapshot_ts"))).alias("validation_start"),
            F.max(F.when(F.col("role") == "validation", F.col("snapshot_ts"))).alias("validation_end"),
        )
        row = borders.select(F.lit(task.name).alias("task"), F.lit(fold).alias("fold"), "*", value.scalar().alias("metric"))
        out = row if out is None else out.unionByName(row)
    return out


def tree_importance(fitted: Fitted, spark) -> DataFrame:
    """Split-gain importance of a tree model with its feature names, ranked (one row per feature)."""
    values = [float(v) for v in fitted.model.featureImportances.toArray()]
    ranked = sorted(zip(fitted.preprocessor.features.all, values), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(ranked)], "feature string, importance double, rank int")


def linear_contributions(df: DataFrame, key: str, target: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long contribution table of one-feature linear effects: slope * (x - mean), per row and feature."""
    row = df.agg(*[F.regr_slope(F.col(target), F.col(n).cast("double")).alias(f"s_{n}") for n in names], *[F.avg(n).alias(f"m_{n}") for n in names]).first()
    parts = F.array(*[
        F.struct(F.lit(n).alias("feature"), (F.lit(row[f"s_{n}"] or 0.0) * (F.col(n).cast("double") - F.lit(row[f"m_{n}"]))).alias("contribution")) for n in names
    ])
    return df.select(key, *keep, F.inline(parts))


def leaf_contributions(model, size: int) -> DataFrame:
    """(tree, leaf, base, gains): what each leaf of a boosted ensemble adds to the prediction, by feature number.

    Every split on the way from the root to a leaf credits its feature with the change of the node's mean it brings, times
    the weight of the tree; `base` is the weighted mean of the root. Leaves are numbered as in `leafCol`, by node number.
    The table has at most trees x 2^depth rows of `size` doubles, whatever the number of samples.
    """
    spark = SparkSession.active()
    path = f"{scratch(spark)}/ensemble"
    model.write().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("mean"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"))
    nodes = written(nodes.join(weights, "tree").withColumn("mean", F.col("mean") * F.col("weight")).drop("weight"), "nodes")
    child = nodes.filter("left < 0 OR node > 0").select("tree", F.col("node").alias("child"), F.col("mean").alias("child_mean"), F.col("left").alias("child_left"), F.col("right").alias("child_right"), F.col("feature").alias("child_feature"))
    here = nodes.filter("node = 0").select("*", F.col("mean").alias("base"), F.array_repeat(F.lit(0.0), size).alias("gains"))
    leaves = here.filter("left < 0").select("tree", "node", "base", "gains")
    for _ in range(max(t.depth for t in model.trees)):
        below = here.filter("left >= 0").select("*", F.explode(F.array("left", "right")).alias("child")).join(child, ["tree", "child"])
        gain = F.col("child_mean") - F.col("mean")
        # a step of its own: beside the new names, the lambda would read those instead of the parent's columns
        below = below.withColumn("gains", F.transform("gains", lambda g, i: F.when(i == F.col("feature"), g + gain).otherwise(g)))
        here = below.select(
            "tree", F.col("child").alias("node"), F.col("child_mean").alias("mean"), F.col("child_left").alias("left"), F.col("child_right").alias("right"), F.col("child_feature").alias("feature"), "base", "gains")
        leaves = leaves.unionByName(here.filter("left < 0").select("tree", "node", "base", "gains"))
    numbered = F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1
    return leaves.select("tree", numbered.alias("leaf"), "base", "gains")


def tree_contributions(fitted: Fitted, df: DataFrame, key: str = "sample_key", keep: Sequence[str] = ()) -> DataFrame:
    """Long table (key, *keep, base, prediction, feature, contribution) of a boosted model over the rows of `df`.

    `base` plus the contributions of a row are its prediction (regression) or its margin (classification), to rounding.
    `key` is unique in `df`. Each row meets one leaf a tree; the sums of a row are complete before the shuffle.
    """
    names = fitted.preprocessor.features.all
    model = fitted.model.copy({fitted.model.leafCol: "__leaves"})
    scored = with_score(model, fitted.preprocessor.transform(df), fitted.task.kind)
    value = F.col("prediction" if fitted.task.kind == "regression" else "score")
    met = scored.select(key, *keep, value.alias("__value"), F.posexplode(vector_to_array("__leaves")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    # bounded by trees x 2^depth, see leaf_contributions
    each = met.join(F.broadcast(written(leaf_contributions(fitted.model, len(names)), "leaves")), ["tree", "leaf"])
    sums = each.groupBy(key).agg(
        *[F.first(c).alias(c) for c in keep], F.sum("base").alias("base"), F.first("__value").alias("prediction"), *[F.sum(F.col("gains")[i]).alias(f"__g{i}") for i in range(len(names))])
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"__g{i}").alias("contribution")) for i, n in enumerate(names)])
    return sums.select(key, *keep, "base", "prediction", F.inline(parts))
