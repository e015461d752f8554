"""Churn model: training columns, encoding, class weights, stratified folds, forest, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import values
from holdfast.operators.features import MISSING_CATEGORY
from holdfast.session import materialize, work_path

# Target, and columns that never reach the model (ids, contact fields, dates, flags
# that leak the target), and the name parts of date columns.
TARGET = "abandono"
DROPPED = (
    "asof_date",
    "customer_id",
    "first_name",
    "last_name",
    "email",
    "phone",
    "signup_date",
    "last_attendance_date",
    "is_active",
    "paid_current_month",
    "last_payment_date",
)
DATE_WORDS = ("date", "fecha")

# Forest settings, folds and seed. Depth 30 is the most Spark allows.
TREES = 600
MAX_DEPTH = 30
MIN_LEAF = 2
FOLDS = 5
SEED = 42

# A task of the training holds the statistics of all open nodes, so few rows are worth a task.
ROWS_PER_TASK = 20_000

WEIGHT, LABEL, VECTOR, FOLD = "_weight", "_label", "_features", "_fold"


def column_roles(df: DataFrame, target: str = TARGET, dropped: Sequence[str] = DROPPED) -> dict[str, str]:
    """Column -> target, dropped, numeric or categorical. A boolean is a category."""
    roles = {}
    for f in df.schema:
        if f.name == target:
            roles[f.name] = "target"
        elif f.name in dropped or any(w in f.name.lower() for w in DATE_WORDS):
            roles[f.name] = "dropped"
        elif isinstance(f.dataType, T.NumericType):
            roles[f.name] = "numeric"
        else:
            roles[f.name] = "categorical"
    return roles


def training_columns(df: DataFrame, target: str = TARGET, dropped: Sequence[str] = DROPPED) -> DataFrame:
    """Role and number of filled values per column of a training table."""
    roles = column_roles(df, target, dropped)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(roles)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("role"), F.col(f"c{i}").alias("filled"))
            for i, (c, r) in enumerate(roles.items())
        ]
    )
    return counts.select(F.inline(entries))


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Contract columns in their model types; all other columns stay as they are."""
    out = df
    for c in numeric:
        is_number = isinstance(df.schema[c].dataType, T.NumericType)
        out = out.withColumn(c, values.number_or_zero(F.col(c), text=not is_number))
    for c in categorical:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)))
    return out


def encoder(numeric: Sequence[str], categorical: Sequence[str], out: str = VECTOR) -> Pipeline:
    """Numbers as they are, then one-hot categories in alphabetical order; an unseen one is all zeros."""
    index = [f"_index_{c}" for c in categorical]
    hot = [f"_onehot_{c}" for c in categorical]
    stages = []
    if categorical:
        stages += [
            StringIndexer(
                inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=index, outputCols=hot),
        ]
    stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol=out))
    return Pipeline(stages=stages)


def categories_of(model: PipelineModel, categorical: Sequence[str]) -> dict[str, list[str]]:
    """Categories per column in encoded order."""
    if not categorical:
        return {}
    return {c: list(labels) for c, labels in zip(categorical, model.stages[0].labelsArray)}


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class). Two rows."""
    n = df.groupBy(F.col(target).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    return n.select(
        "label",
        "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, target: str = TARGET) -> DataFrame:
    label = F.col(target).cast("int")
    weight = F.lit(None).cast("double")
    for r in class_weights(df, target).collect():
        weight = F.when(label == r["label"], float(r["weight"])).otherwise(weight)
    return df.withColumn(WEIGHT, weight).withColumn(LABEL, label.cast("double"))


def stratified_folds(
    df: DataFrame, target: str = TARGET, folds: int = FOLDS, seed: int = SEED, bucket_rows: int = 200_000
) -> DataFrame:
    """Fold 0..folds-1 per row, in random order, with sizes per class that differ by one row at most.

    The order is a hash of the seed and the whole row, so it does not depend on how the rows are spread. Rows fall
    into buckets of about ``bucket_rows`` by it, so no class and no key fills one bucket, unless its rows are all equal. The place of a row
    among its class is the class's rows in earlier buckets plus its row number in the bucket.
    """
    draw, bucket, place = "_draw", "_bucket", "_place"
    scale = 1 << 52
    drawn = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(scale)) / F.lit(float(scale))
    fixed = materialize(df.withColumn(draw, drawn))
    total = fixed.count()
    n_buckets = max(1, -(-total // bucket_rows))
    bucketed = fixed.withColumn(bucket, F.floor(F.col(draw) * n_buckets).cast("int"))
    # Two classes times the bucket count.
    counts = bucketed.groupBy(target, bucket).count().collect()
    by_class: dict = {}
    for r in counts:
        by_class.setdefault(r[target], {})[r[bucket]] = r["count"]
    start = F.lit(0).cast("bigint")
    for label, sizes in by_class.items():
        before = list(accumulate([sizes.get(b, 0) for b in range(n_buckets)], initial=0))[:-1]
        earlier = F.get(values.literal_bigints(before), F.col(bucket))
        start = F.when(F.col(target).eqNullSafe(F.lit(label)), earlier).otherwise(start)
    inside = Window.partitionBy(target, bucket).orderBy(draw)
    return (
        bucketed.withColumn(place, start + F.row_number().over(inside) - 1)
        .withColumn(FOLD, (F.col(place) % folds).cast("int"))
        .drop(draw, bucket, place)
    )


def forest_classifier(trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = SEED, **params) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=VECTOR,
        labelCol=LABEL,
        weightCol=WEIGHT,
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=MIN_LEAF,
        featureSubsetStrategy="sqrt",
        maxBins=params.pop("maxBins", 256),
        maxMemoryInMB=params.pop("maxMemoryInMB", 1024),
        cacheNodeIds=params.pop("cacheNodeIds", True),
        seed=seed,
        **params,
    )


def training_tasks(spark: SparkSession, rows: int) -> int:
    return max(1, min(4 * spark.sparkContext.defaultParallelism, rows // ROWS_PER_TASK))


def train(
    df: DataFrame,
    target: str = TARGET,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    dropped: Sequence[str] = DROPPED,
    checkpoint: bool = True,
    **params,
) -> tuple[PipelineModel, dict]:
    """Fit the encoder and a balanced forest on all rows; returns the model and its contract.

    The rows are read many times, so they are checkpointed unless the caller has done it.
    """
    roles = column_roles(df, target, dropped)
    numeric = [c for c, r in roles.items() if r == "numeric"]
    categorical = [c for c, r in roles.items() if r == "categorical"]
    columns = [F.col(c) for c in (*numeric, *categorical, target)]
    data = prepare(df.select(*columns), numeric, categorical)
    if checkpoint:
        data = materialize(data)
        data = data.repartition(training_tasks(df.sparkSession, data.count()))
    data = with_class_weight(data, target)
    encode = encoder(numeric, categorical).fit(data)
    forest = forest_classifier(trees, max_depth, seed, **params).fit(encode.transform(data))
    # The copy leaves the training summary behind, which would drag the session into every task.
    model = PipelineModel(stages=[*encode.stages, forest.copy()])
    contract = {
        "feature_order": [c for c, r in roles.items() if r in ("numeric", "categorical")],
        "numeric_cols": numeric,
        "categorical_cols": categorical,
        "categories": categories_of(encode, categorical),
    }
    return model, contract


def dealt(df: DataFrame) -> DataFrame:
    """The rows, dealt evenly to several tasks a core.

    A score costs about a millisecond a row, so the few tasks that suffice for the bytes of the rows are too few for it.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def probability(df: DataFrame, model: PipelineModel, out: str = "churn_risk", keep_vector: bool = False) -> DataFrame:
    """Probability of class 1 next to the input columns; the encoded vector as array ``x`` on request."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    columns = [*df.columns, out]
    if keep_vector:
        scored = scored.withColumn("x", vector_to_array(VECTOR))
        columns.append("x")
    return scored.select(*columns)


def auc(df: DataFrame, score: str = "churn_risk", label: str = LABEL) -> float:
    """Exact area under the ROC curve, ties counted half."""
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(rows)


def auc_by(df: DataFrame, group: str, score: str = "churn_risk", label: str = LABEL) -> DataFrame:
    """Exact area under the ROC curve per group from the ranks of the positives, ties counted half; NULL for one class.

    Rows are counted per group and score first, so tied scores cost one row. The steps are then dealt to ranges of group
    and score. Ranks inside a range need that range only; those of the ranges before it follow from their
    counts, one row per group and range. So no task holds a group.
    """
    part, inside = "_part", "_inside"
    hit = F.col(label).cast("double")
    steps = df.groupBy(group, score).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("p"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = steps.repartitionByRange(ranges, group, score).withColumn(part, F.spark_partition_id())
    earlier = Window.partitionBy(group, part).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn(inside, F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    by_range = ranked.groupBy(group, part).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col(inside) + (F.col("n") + 1) / 2)).alias("ranks")
    )
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank_sum = F.sum(F.col("ranks") + F.col("below") * F.col("p"))
    total, positive = F.sum("n"), F.sum("p")
    area = F.try_divide(rank_sum - positive * (positive + 1) / 2, positive * (total - positive))
    return by_range.groupBy(group).agg(
        total.alias("rows"), positive.cast("bigint").alias("positives"), F.round(area, 9).alias("auc")
    )


def bounded_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most so many rows, those with the least hashes of the key: a bound on the rows a model is fitted on."""
    return df.orderBy(F.xxhash64(F.lit(SEED), key), key).limit(rows)


def _fold_weights(sizes: dict[tuple[int, float], int], fold: int) -> dict[float, float]:
    """Balanced weight per class among the rows outside of a fold."""
    rest: dict[float, int] = {}
    for (f, label), n in sizes.items():
        if f != fold:
            rest[label] = rest.get(label, 0) + n
    if len(rest) < 2:
        raise ValueError("each class needs rows in at least two folds")
    return {label: sum(rest.values()) / (len(rest) * n) for label, n in rest.items()}


def out_of_fold_scores(
    df: DataFrame,
    target: str = TARGET,
    folds: int = FOLDS,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    dropped: Sequence[str] = DROPPED,
    keep: Sequence[str] = (),
    train_rows: int | None = None,
    **params,
) -> DataFrame:
    """Every row once, scored by a forest that has not seen its fold: ``keep`` columns, _fold, _label, churn_risk.

    The rows are dealt to stratified folds and encoded once; the encoded matrix is stored, and the fits of all folds run
    on it as concurrent jobs. A category that only the held-out fold has is a column of zeros to the fit, which no
    split can use. Class weights are those of the fitted rows. ``train_rows`` bounds the rows a fit is given; all rows are scored.
    The scores are stored as each fit ends, so no model outlives its thread.
    """
    spark: SparkSession = df.sparkSession
    roles = column_roles(df, target, dropped)
    numeric = [c for c, r in roles.items() if r == "numeric"]
    categorical = [c for c, r in roles.items() if r == "categorical"]
    kept = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)]
    columns = [*kept, *(F.col(c) for c in (*numeric, *categorical, target))]
    data = prepare(stratified_folds(df.select(*columns), target, folds, seed), numeric, categorical)
    data = materialize(data.withColumn(LABEL, F.col(target).cast("int").cast("double")))
    encoded = encoder(numeric, categorical).fit(data).transform(data)
    matrix = materialize(encoded.select(*[f"_keep_{i}" for i in range(len(keep))], FOLD, LABEL, VECTOR))
    # Folds times classes.
    sizes = {(r[FOLD], r[LABEL]): r["count"] for r in matrix.groupBy(FOLD, LABEL).count().collect()}
    folder = work_path(spark, "folds")

    def fit(fold: int) -> str:
        weight = F.lit(None).cast("double")
        for label, w in _fold_weights(sizes, fold).items():
            weight = F.when(F.col(LABEL) == label, w).otherwise(weight)
        rows = matrix.filter(F.col(FOLD) != fold).select(LABEL, VECTOR, weight.alias(WEIGHT))
        n = sum(size for (f, _), size in sizes.items() if f != fold)
        if train_rows is not None and n > train_rows:
            rows, n = rows.orderBy(F.xxhash64(F.lit(seed), LABEL, vector_to_array(VECTOR))).limit(train_rows), train_rows
        # The copy leaves the training summary behind, as in `train`.
        model = forest_classifier(trees, max_depth, seed, **params).fit(rows.repartition(training_tasks(spark, n))).copy()
        scored = model.transform(matrix.filter(F.col(FOLD) == fold))
        names = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]
        path = f"{folder}/{fold}"
        scored.select(*names, FOLD, LABEL, vector_to_array("probability")[1].alias("churn_risk")).write.parquet(path)
        return path

    with ThreadPoolExecutor(folds) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(fit), sorted({f for f, _ in sizes})))
    return spark.read.parquet(*paths)


def cross_validate(df: DataFrame, target: str = TARGET, folds: int = FOLDS, **settings) -> DataFrame:
    """Fold, its rows and positives, and the AUC of the forest trained on the other folds; settings as for the scores."""
    scored = out_of_fold_scores(df, target, folds, **settings)
    return auc_by(scored.withColumnRenamed(FOLD, "fold"), "fold")
