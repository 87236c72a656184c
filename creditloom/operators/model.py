"""Default model: random forest and logistic regression, blended; scoring of applications."""

from __future__ import annotations

import contextvars
import datetime as dt
import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.operators import metrics
from creditloom.operators.training_set import (
    FULL_CATEGORICAL,
    FULL_NUMERIC,
    LABEL,
    VERSIONED_CATEGORICAL,
    VERSIONED_NUMERIC,
    FeatureSpec,
    class_counts,
    class_weight,
    cv_folds,
    encode,
    fit_features,
    fit_fold_features,
    time_split,
)
from creditloom.session import side_by_side, stages_of_run, write_stage

# Weights of the blend, the class threshold and the columns of a prediction.
RF_WEIGHT, LR_WEIGHT = 0.70, 0.30
CLASS_THRESHOLD = 0.5
SCORE_COLUMNS = [
    "application_id",
    "customer_id",
    "pd_probability_rf",
    "pd_probability_lr",
    "pd_probability_ens",
    "pd_prediction",
    "risk_grade",
    "model_version",
    "scored_at",
]
_KEYS = ["application_id", "customer_id"]


@dataclass(frozen=True)
class Profile:
    """Features and forest size of a training run."""

    numeric: tuple
    categorical: tuple
    trees: int
    depth: int
    min_leaf: int = 1
    c: float = 1.0
    seed: int = 42


# The two training profiles.
FULL = Profile(tuple(FULL_NUMERIC), tuple(FULL_CATEGORICAL), trees=300, depth=12, min_leaf=10)
VERSIONED = Profile(tuple(VERSIONED_NUMERIC), tuple(VERSIONED_CATEGORICAL), trees=100, depth=8)


@dataclass
class PdModel:
    """Everything needed to score a row: learnt features, scaler and the two models."""

    spec: FeatureSpec
    scaler: StandardScalerModel
    rf: RandomForestClassificationModel
    lr: LogisticRegressionModel

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for part in ("scaler", "rf", "lr"):
            getattr(self, part).write().overwrite().save(f"{path}/{part}")
        text = spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @staticmethod
    def load(path: str) -> PdModel:
        spark = SparkSession.active()
        spec = FeatureSpec(**json.loads(spark.read.text(f"{path}/features").first()[0]))
        return PdModel(
            spec,
            StandardScalerModel.load(f"{path}/scaler"),
            RandomForestClassificationModel.load(f"{path}/rf"),
            LogisticRegressionModel.load(f"{path}/lr"),
        )


def _vectors(encoded: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(encoded)


def _forest(profile: Profile) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL,
        featuresCol="features",
        weightCol="class_weight",
        numTrees=profile.trees,
        maxDepth=profile.depth,
        minInstancesPerNode=profile.min_leaf,
        featureSubsetStrategy="sqrt",
        # more node statistics per pass over the data, so fewer passes
        maxMemoryInMB=1024,
        seed=profile.seed,
    )


#: Rows of a training task.  With the key it fixes which rows a task has and in what order.
_ROWS_PER_TASK = 5_000
#: Training tasks at most.  Every task of a fit sends the statistics of all open tree nodes, whose
#: number is set by the profile, so traffic grows with the tasks and must not grow with the rows.
_MOST_TASKS = 48
_ROW_KEY = "application_id"
#: Rows of the folds that are fitted at a time.
_ROWS_AT_ONCE = 2_000_000


def _encoded(
    training: DataFrame, profile: Profile, name: str, spec: FeatureSpec | None = None
) -> tuple[FeatureSpec, Callable[[DataFrame], DataFrame], DataFrame]:
    """Learnt features, the layout for fits, and the weighted, encoded rows.

    The rows are written because fits read them often.  A forest draws its samples by task, so
    the tasks must be the same on every cluster: their number follows from the number of rows
    (up to ``_MOST_TASKS``) and their rows from the key.  The layout is applied right before a fit, since reading a
    table packs its files by the number of cores.
    """
    spec, counts = side_by_side(
        lambda: spec or fit_features(training, profile.numeric, profile.categorical),
        lambda: class_counts(training),
    )
    encoded = encode(training, spec, keep=[_ROW_KEY, LABEL])
    weighted = encoded.withColumn("class_weight", class_weight(counts))
    tasks = min(max(1, sum(counts.values()) // _ROWS_PER_TASK), _MOST_TASKS)

    def laid_out(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, _ROW_KEY).sortWithinPartitions(_ROW_KEY, *rows.columns)

    return spec, laid_out, write_stage(weighted, name)


def fit(train: DataFrame, profile: Profile = VERSIONED) -> PdModel:
    """Fit on labelled rows; medians, category levels and weights come from these rows only."""
    spec, laid_out, rows = _encoded(train, profile, "encoded")
    vectors = _vectors(laid_out(rows), spec.columns).select(LABEL, "class_weight", "features")
    # shuffled and sorted once: both fits pass over the vectors many times
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rf, (scaler, lr) = side_by_side(
            lambda: _forest(profile).fit(vectors), lambda: _regression(vectors, profile)
        )
    finally:
        vectors.unpersist()
    return PdModel(spec, scaler, rf, lr)


def _regression(
    vectors: DataFrame, profile: Profile
) -> tuple[StandardScalerModel, LogisticRegressionModel]:
    """Standardise, then fit; L2 strength is given as C, the weight of the summed loss."""
    scaler = StandardScaler(
        inputCol="features", outputCol="scaled", withMean=True, withStd=True
    ).fit(vectors)
    # the loss minimised here is an average over the weights, hence the division
    total = vectors.agg(F.sum("class_weight")).first()[0]
    lr = LogisticRegression(
        labelCol=LABEL,
        featuresCol="scaled",
        weightCol="class_weight",
        regParam=1.0 / (profile.c * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    )
    return scaler, lr.fit(scaler.transform(vectors))


def _probability(model, df: DataFrame, features: str, name: str) -> DataFrame:
    raw, label = f"_{name}_raw", f"_{name}_label"
    copy = model.copy()
    copy.setFeaturesCol(features).setProbabilityCol(f"_{name}")
    copy.setRawPredictionCol(raw).setPredictionCol(label)
    scored = copy.transform(df)
    return scored.withColumn(name, vector_to_array(f"_{name}")[1]).drop(f"_{name}", raw, label)


def blend(df: DataFrame) -> DataFrame:
    """Add blended PD, class and grade from the two model probabilities."""
    ens = RF_WEIGHT * F.col("pd_probability_rf") + LR_WEIGHT * F.col("pd_probability_lr")
    pd = F.col("pd_probability_ens")
    return df.withColumn("pd_probability_ens", ens).withColumns(
        {
            "pd_prediction": bands.flag(pd >= CLASS_THRESHOLD),
            "risk_grade": bands.risk_grade(pd),
        }
    )


def predict(frame: DataFrame, model: PdModel, keep: list[str] | None = None) -> DataFrame:
    """Probabilities, class and grade for every row of a scoring frame."""
    keep = _KEYS if keep is None else keep
    vectors = _vectors(encode(frame, model.spec, keep=keep), model.spec.columns).select(
        *keep, "features"
    )
    rf = _probability(model.rf, vectors, "features", "pd_probability_rf")
    lr = _probability(model.lr, model.scaler.transform(rf), "scaled", "pd_probability_lr")
    return blend(lr.drop("features", "scaled"))


def predict_values(df: DataFrame, model: PdModel, values: str) -> DataFrame:
    """Add probabilities, class and grade of rows whose encoded features stand in an array."""
    vectors = df.withColumn("features", array_to_vector(values))
    rf = _probability(model.rf, vectors, "features", "pd_probability_rf")
    lr = _probability(model.lr, model.scaler.transform(rf), "scaled", "pd_probability_lr")
    return blend(lr.drop("features", "scaled"))


def score(
    frame: DataFrame, model: PdModel, version: str, scored_at: dt.datetime | None = None
) -> DataFrame:
    """Rows of the predictions table."""
    at = F.current_timestamp() if scored_at is None else F.lit(str(scored_at)).cast("timestamp")
    stamped = predict(frame, model).withColumns({"model_version": F.lit(version), "scored_at": at})
    return stamped.select(*SCORE_COLUMNS)


def evaluate(scored: DataFrame, label: str = LABEL) -> dict[str, float]:
    """AUC of both models and the blend, average precision of the blend; rounded to 4."""
    names = {
        "rf_auc": "pd_probability_rf",
        "lr_auc": "pd_probability_lr",
        "ensemble_auc": "pd_probability_ens",
    }
    long = scored.select(
        label,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(c).alias("score"))
                    for m, c in names.items()
                ]
            )
        ),
    )
    aucs, ap = side_by_side(
        # one row per metric
        lambda: metrics.roc_auc(long, "score", label, by=["metric"]).collect(),
        lambda: metrics.average_precision(scored, "pd_probability_ens", label).first(),
    )
    found = {r["metric"]: r["auc"] for r in aucs}
    found["avg_precision"] = ap["average_precision"]
    order = [*names, "avg_precision"]
    return {m: None if found.get(m) is None else round(found[m], 4) for m in order}


@dataclass
class TrainingRun:
    """A fitted model with what the registry records about it."""

    model: PdModel
    metrics: dict[str, float]
    train_rows: int
    test_rows: int
    test_scores: DataFrame

    @property
    def feature_count(self) -> int:
        return len(self.model.spec.columns)


def train(frame: DataFrame, profile: Profile = VERSIONED) -> TrainingRun:
    """Time-ordered 80/20 split, fit on the earlier part, evaluate on the later part."""
    split = write_stage(time_split(frame), "split")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    model = fit(split.where(F.col("split") == "train"), profile)
    test = split.where(F.col("split") == "test")
    scores = write_stage(predict(test, model, keep=[*_KEYS, LABEL]), "test_scores")
    return TrainingRun(
        model, evaluate(scores), sizes.get("train", 0), sizes.get("test", 0), scores
    )


def cross_validate(
    frame: DataFrame, profile: Profile = FULL, k: int = 5, parallel: int = 1
) -> dict:
    """AUC of the forest on each of k stratified folds, with mean and population deviation.

    ``parallel`` folds are fitted at a time, fewer if they have over ``_ROWS_AT_ONCE`` rows together;
    each keeps its training rows with a count per tree, in memory and on disk, until it is done.
    """
    used = frame.select(_ROW_KEY, LABEL, *profile.numeric, *profile.categorical)
    folds = write_stage(cv_folds(used, k), "folds")
    parallel = max(1, min(parallel, _ROWS_AT_ONCE // max(1, folds.count())))
    specs = fit_fold_features(folds, profile.numeric, profile.categorical, k)

    def auc(i: int) -> float:
        training, held_out = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        spec, laid_out, rows = _encoded(training, profile, "fold_rows", specs[i])
        rf = _forest(profile).fit(_vectors(laid_out(rows), spec.columns))
        test = _vectors(encode(held_out, spec, keep=[LABEL]), spec.columns)
        scored = _probability(rf, test, "features", "pd_probability_rf")
        return metrics.roc_auc(scored, "pd_probability_rf", LABEL).first()["auc"]

    def alone(i: int) -> float:
        with stages_of_run(frame.sparkSession):
            found = auc(i)
        # shuffle files go when the driver drops what refers to them
        frame.sparkSession._jvm.System.gc()
        return found

    with ThreadPoolExecutor(parallel) as pool:
        jobs = [pool.submit(contextvars.copy_context().run, alone, i) for i in range(k)]
        aucs = [job.result() for job in jobs]
    mean = sum(aucs) / k
    std = (sum((a - mean) ** 2 for a in aucs) / k) ** 0.5
    return {"folds": aucs, "mean": mean, "std": std}


def score_missing(
    frame: DataFrame, cached: DataFrame, scorer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Scores for every application: stored ones as they are, the rest scored now.

    ``cached`` has one row per application.  ``scorer`` maps a scoring frame to prediction
    rows; ``source`` says where a score came from.
    """
    waiting = frame.join(cached.select("application_id"), "application_id", "left_anti")
    columns = [c for c in SCORE_COLUMNS if c != "scored_at"]
    stored = cached.select(*columns).withColumn("source", F.lit("cache"))
    live = scorer(waiting).select(*columns).withColumn("source", F.lit("live_inference"))
    return stored.unionByName(live)


def logistic_scorer(
    weights: Mapping[str, tuple[float, float]], intercept: float, version: str
) -> Callable[[DataFrame], DataFrame]:
    """A scorer with given coefficients: feature -> (weight, centre); missing values count 0."""

    def run(frame: DataFrame) -> DataFrame:
        z = F.lit(float(intercept))
        for c, (weight, centre) in weights.items():
            z = z + F.coalesce((F.col(c).cast("double") - centre) * weight, F.lit(0.0))
        p = F.round(1 / (1 + F.exp(-z)), 6)
        scored = frame.withColumns({"pd_probability_rf": p, "pd_probability_lr": p})
        rounded = blend(scored).withColumn(
            "pd_probability_ens", F.round("pd_probability_ens", 6)
        )
        return rounded.withColumn("model_version", F.lit(version))

    return run
