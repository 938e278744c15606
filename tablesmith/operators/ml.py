"""Training, prediction and clustering on Spark ML pipelines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.numbers import ratio
from tablesmith.operators.fill import medians
from tablesmith.operators.quantiles import order_statistics
from tablesmith.session import broadcast_if_small
from tablesmith.types import col, numeric_columns, q, require_columns

REGRESSION, CLASSIFICATION = "regression", "classification"
MISSING_CATEGORY = "__missing__"
# StringIndexer keeps its labels on the driver.
MAX_CATEGORIES = 10_000
MIN_ROWS = 5
_STARTS_AT_ONCE = 5
MODELS = {
    "linear_regression": (REGRESSION, lambda: LinearRegression()),
    "logistic_regression": (CLASSIFICATION, lambda: LogisticRegression()),
    "random_forest_regressor": (REGRESSION, lambda: RandomForestRegressor(numTrees=100, seed=42)),
    "random_forest_classifier": (CLASSIFICATION, lambda: RandomForestClassifier(numTrees=100, seed=42)),
}
_DEFAULTS = {REGRESSION: "random_forest_regressor", CLASSIFICATION: "random_forest_classifier"}


def infer_task(df: DataFrame, target: str) -> str:
    """Regression for a numeric target of more than ten values, else classification."""
    if target not in numeric_columns(df):
        return CLASSIFICATION
    few = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(11).count()
    return CLASSIFICATION if few <= 10 else REGRESSION


def feature_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str], list[str]]:
    """Pipeline stages that turn raw columns into ``features``.

    Numbers: the exact median for missing values, then standardised. Other columns: missing is a
    category of its own, one-hot, categories not seen in training count as none.
    """
    numeric = [c for c in features if c in numeric_columns(df, features)]
    categorical = [c for c in features if c not in numeric]
    for c in categorical:
        if df.select(col(c)).distinct().limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
            raise ValueError(f"'{c}' has more than {MAX_CATEGORIES} categories; drop it or group its values first")
    middle = medians(df, numeric)
    numbers = [f"coalesce(CAST({q(c)} AS DOUBLE), {middle[c] or 0.0!r}D) AS __n{i}" for i, c in enumerate(numeric)]
    labels = [f"coalesce(CAST({q(c)} AS STRING), '{MISSING_CATEGORY}') AS __c{i}" for i, c in enumerate(categorical)]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(numbers + labels)} FROM __THIS__")]
    parts = []
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"__n{i}" for i in range(len(numeric))], outputCol="__numbers"))
        stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True))
        parts.append("__scaled")
    if categorical:
        raw, indexed, hot = ([f"{p}{i}" for i in range(len(categorical))] for p in ("__c", "__k", "__h"))
        stages.append(StringIndexer(inputCols=raw, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot))
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages, numeric, categorical


def train_test_split(
    df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add ``is_test``: exactly ``test_size`` of the rows (of each class), the same on every run.

    Rows are drawn by the hash of their id. The cut is the hash at the wanted rank, found without
    sorting or gathering a class, however large it is.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    group = col(stratify).cast("string") if stratify else F.lit("all")
    draw = F.shiftrightunsigned(F.xxhash64(col(row_id), F.lit(seed)), 11).cast("double")
    drawn = df.withColumn("__class", group).withColumn("__draw", draw)
    wanted = F.round(F.col("size") * test_size) if stratify else F.ceil(F.col("size") * test_size)
    sizes = drawn.groupBy(F.col("__class").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    ranks = sizes.withColumn("rank", wanted.cast("bigint") - 1).where("rank >= 0").select("key", "rank", "size")
    cuts = order_statistics(drawn, "__class", "__draw", ranks)
    cuts = broadcast_if_small(cuts.select(F.col("key").alias("__class"), F.col("answer").alias("__cut")))
    is_test = F.coalesce(F.col("__draw") <= F.col("__cut"), F.lit(False))
    return drawn.join(cuts, "__class", "left").withColumn("is_test", is_test).drop("__class", "__draw", "__cut")


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline and how it did on the held-out rows (``metrics`` is one row)."""

    model: PipelineModel
    metrics: DataFrame
    task: str
    target: str
    features: list[str]
    numeric_features: list[str]
    categorical_features: list[str]
    test_size: float
    rows_used: int
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])


def regression_metrics(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row ``(r2, mae, rmse)``."""
    y, gap = col(label).cast("double"), col(label).cast("double") - col(prediction)
    spread = F.var_pop(y) * F.count(y)
    return scored.agg(
        (1 - ratio(F.sum(gap * gap), spread)).alias("r2"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row ``(accuracy)``."""
    hit = col(label).cast("string") == col(prediction).cast("string")
    return scored.agg(F.avg(hit.cast("double")).alias("accuracy"))


def train(
    df: DataFrame,
    target: str,
    row_id: str,
    features: Sequence[str] | None = None,
    task: str | None = None,
    model_type: str | None = None,
    test_size: float = 0.2,
) -> Trained:
    """Fit a model on the rows whose target is known and measure it on held-out rows."""
    require_columns(df, [target, row_id, *(features or [])])
    task = task or infer_task(df, target)
    if task not in _DEFAULTS:
        raise ValueError(f"task is {REGRESSION} or {CLASSIFICATION}")
    model_type = model_type or _DEFAULTS[task]
    if model_type not in MODELS:
        raise ValueError(f"unknown model '{model_type}'; one of {', '.join(MODELS)}")
    if MODELS[model_type][0] != task:
        raise ValueError(f"'{model_type}' does not do {task}")
    chosen = [c for c in (features or df.columns) if c not in (target, row_id)]
    known = df.where(col(target).isNotNull())
    rows = known.count()
    if rows < MIN_ROWS:
        raise ValueError(f"training needs at least {MIN_ROWS} rows")
    split = train_test_split(known, row_id, test_size, stratify=target if task == CLASSIFICATION else None)
    # read once per iteration of the fit
    split = split.select(*[col(c) for c in dict.fromkeys([*chosen, target])], "is_test").persist()
    try:
        fit_rows, held_out = split.where("NOT is_test"), split.where("is_test")
        stages, numeric, categorical = feature_stages(fit_rows, chosen)
        estimator = MODELS[model_type][1]().setFeaturesCol("features").setLabelCol("__label")
        if task == REGRESSION:
            labelled = fit_rows.withColumn("__label", col(target).cast("double"))
            model = Pipeline(stages=[*stages, estimator]).fit(labelled)
            metrics = regression_metrics(model.transform(held_out), target)
        else:
            named = fit_rows.withColumn("__class", col(target).cast("string"))
            indexer = StringIndexer(inputCol="__class", outputCol="__label", stringOrderType="alphabetAsc").fit(named)
            fitted = Pipeline(stages=[*stages, estimator.setPredictionCol("__predicted")]).fit(indexer.transform(named))
            back = IndexToString(inputCol="__predicted", outputCol="prediction", labels=indexer.labels)
            model = PipelineModel([*fitted.stages, back])
            metrics = accuracy(model.transform(held_out), target)
        scores = metrics.first().asDict()
    finally:
        split.unpersist()
    # the scores outlive the cached split they were measured on
    measured = df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in scores.items()])
    return Trained(model, measured, task, target, chosen, numeric, categorical, test_size, rows)


def predict(trained: Trained, df: DataFrame) -> DataFrame:
    """The table with a ``prediction`` column; a missing feature column is an error."""
    require_columns(df, trained.features)
    scored = trained.model.transform(df)
    return scored.select(*[col(c) for c in df.columns if c != "prediction"], "prediction")


@dataclass(frozen=True)
class Clusters:
    """A k-means result: ``sizes`` (cluster, size), ``centers`` (cluster, feature, mean), ``summary``."""

    data: DataFrame
    sizes: DataFrame
    centers: DataFrame
    summary: DataFrame


def cluster(df: DataFrame, features: Sequence[str] | None = None, n_clusters: int = 3, n_init: int = 10) -> Clusters:
    """K-means over standardised numeric columns, the best of ``n_init`` starts.

    ``data`` is the table with a ``cluster`` column, null where a feature is missing. The label is
    the nearest centre written as an expression over the row, so no join brings it back.
    """
    if not 2 <= n_clusters <= 20:
        raise ValueError("n_clusters is 2..20")
    require_columns(df, features or [])
    names = numeric_columns(df, features)
    if not names:
        raise ValueError("clustering needs a numeric column")
    complete = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    inputs = [f"x{i}" for i in range(len(names))]
    assembled = VectorAssembler(inputCols=inputs, outputCol="raw").transform(complete)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
    ready = scaler.transform(assembled).select("features").persist()
    try:
        rows = ready.count()
        if rows < n_clusters:
            raise ValueError(f"clustering needs at least {n_clusters} complete rows")

        def fit(i: int):
            return KMeans(k=n_clusters, seed=42 + i, featuresCol="features").fit(ready)

        # a start is many short jobs over few partitions: several at once keep the cluster busy
        with ThreadPoolExecutor(_STARTS_AT_ONCE) as pool:
            fits = list(pool.map(fit, range(n_init)))
        best = min(fits, key=lambda m: m.summary.trainingCost)
        labelled = best.transform(ready)
        silhouette = None
        if labelled.select("prediction").distinct().limit(2).count() > 1:
            silhouette = float(ClusteringEvaluator(featuresCol="features").evaluate(labelled))
        # the scaler divides by the sample deviation; in population deviations the cost is larger
        inertia = float(best.summary.trainingCost) * rows / max(rows - 1, 1)
    finally:
        ready.unpersist()
    centres = [[float(v) for v in c] for c in best.clusterCenters()]
    mean, std = [float(v) for v in scaler.mean], [float(v) for v in scaler.std]

    def distance(centre: list[float]):
        total = F.lit(0.0)
        for c, m, s, at in zip(names, mean, std, centre):
            gap = (col(c) - F.lit(m)) / F.lit(s) - F.lit(at) if s else F.lit(0.0) * col(c)
            total = total + gap * gap
        return total

    gaps = F.array(*[distance(c) for c in centres])
    nearest = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("bigint")
    known = F.lit(True)
    for c in names:
        known = known & col(c).isNotNull()
    data = df.withColumn("cluster", F.when(known, nearest))
    sizes = data.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    spark = df.sparkSession
    where = [
        (k, c, m + s * v) for k, centre in enumerate(centres) for c, m, s, v in zip(names, mean, std, centre)
    ]
    summary = spark.createDataFrame(
        [(n_clusters, rows, inertia, silhouette)], "n_clusters bigint, rows_used bigint, inertia double, silhouette double"
    )
    return Clusters(data, sizes, spark.createDataFrame(where, "cluster bigint, feature string, mean double"), summary)


class ModelFolder:
    """Fitted pipelines below one shared folder: each a Spark ML directory plus a line of facts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, model_id: str, part: str) -> str:
        if not model_id.isalnum():
            raise ValueError("a model id has letters and digits only")
        return f"{self.root}/{model_id}/{part}"

    def save(self, trained: Trained) -> str:
        trained.model.write().overwrite().save(self._path(trained.model_id, "pipeline"))
        facts = {k: v for k, v in _facts_of(trained).items() if k not in ("model", "metrics")}
        facts["metrics"] = trained.metrics.first().asDict()
        line = self.spark.range(1).select(F.lit(json.dumps(facts)).alias("value"))
        line.coalesce(1).write.mode("overwrite").text(self._path(trained.model_id, "facts"))
        return trained.model_id

    def load(self, model_id: str) -> Trained:
        facts = json.loads(self.spark.read.text(self._path(model_id, "facts")).first()[0])
        scores = facts.pop("metrics")
        metrics = self.spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in scores.items()])
        return Trained(model=PipelineModel.load(self._path(model_id, "pipeline")), metrics=metrics, **facts)

    def list(self) -> DataFrame:
        """``(model_id, task, target, rows_used)`` of every saved model."""
        kinds = "model_id string, task string, target string, rows_used bigint"
        facts = self.spark.read.text(f"{self.root}/*/facts")
        return facts.select(F.from_json("value", kinds).alias("f")).select("f.*")

    def delete(self, model_id: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(model_id, "").rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _facts_of(trained: Trained) -> dict:
    return {k: getattr(trained, k) for k in trained.__dataclass_fields__}


