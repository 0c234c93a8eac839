"""Training and tuning on Spark ML (i01, i02, i08-i10).

Models are MLlib estimators inside a ``Pipeline`` (distributed histogram
training); cross-validation reuses the deterministic folds of
``features.stratified_kfold`` through ``CrossValidator(foldCol=...)``.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import md5_uniform
from vigil.operators.forest import CellForest, train_cells
from vigil.operators.tuning import nested_grid
from vigil.session import cut_lineage


def _prep(features: list[str], impute: bool = True):
    stages = []
    if impute:
        stages.append(Imputer(inputCols=features, outputCols=[f"{c}_imp" for c in features], strategy="mean"))
        cols = [f"{c}_imp" for c in features]
    else:
        cols = features
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    return stages


def _as_double(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.withColumns({**{c: F.col(c).cast("double") for c in features},
                           label: F.col(label).cast("double")})


#: Rows of a training task: a forest of 100 trees holds some 450 bytes of each in its cache.
ROWS_A_TASK = 200_000
#: Rows up to which MLlib fits a forest, walking each row down each tree at every level; more are counted by cells.
FOREST_ROWS = 200_000


def _held(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a fit reads, written once, as its passes would compute the input again, and dealt out where a
    task had more than ROWS_A_TASK rows."""
    return _dealt(cut_lineage(df.select(*columns)))


def _dealt(rows: DataFrame) -> DataFrame:
    parts = -(-rows.count() // ROWS_A_TASK)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def train_random_forest(df: DataFrame, features: list[str], label: str = "target", num_trees: int = 100,
                        max_depth: int = 10, seed: int = 42) -> PipelineModel | CellForest:
    """i01: imputer -> assembler -> random forest (100 trees, depth 10, seed 42).

    Above FOREST_ROWS the same forest, with other draws, grows on counted cells (``forest``) as long as the features
    fall into a bounded number of bin combinations."""
    rows = cut_lineage(_as_double(df, features, label).select(*features, label))
    forest = train_cells(rows, features, label, num_trees, max_depth, seed) if rows.count() > FOREST_ROWS else None
    if forest is not None:
        return forest
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[*_prep(features), rf]).fit(_dealt(rows))


def train_boosted_trees(df: DataFrame, features: list[str], label: str = "target", max_iter: int = 100,
                        max_depth: int = 5, seed: int = 42) -> PipelineModel:
    """i02: gradient-boosted trees (the boosted-tree variants of the reference)."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[*_prep(features), gbt]).fit(_held(_as_double(df, features, label), [*features, label]))


def predict(model: PipelineModel | CellForest, df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Apply a fitted pipeline; adds ``prediction`` and ``probability_1`` (positive class)."""
    from pyspark.ml.functions import vector_to_array
    d = df.withColumns({c: F.col(c).cast("double") for c in features})
    if label is not None and label in df.columns:
        d = d.withColumn(label, F.col(label).cast("double"))
    if isinstance(model, CellForest):
        return model.predict(d)
    out = model.transform(d)
    return out.withColumn("probability_1", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", *[f"{c}_imp" for c in features])


# The default grid, 27 points (a split needs 2, 5 or 10 rows: 1, 3 or 5 in a leaf).
GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 3, 5]}


def grid_search_cv(df: DataFrame, features: list[str], label: str, fold_col: str,
                   grid: dict | None = None, parallelism: int = 4, seed: int = 42, num_folds: int = 5) -> DataFrame:
    """i08: parameter grid x k folds (given fold column) on positive-class recall.
    Returns one row per parameter combination with the mean CV recall.  Without ``grid``: GRID.

    The three parameters of GRID are searched nested (``tuning.nested_grid``: every fold and leaf size is grown
    once) as long as the features fall into a bounded number of bin combinations; other grids, and many features,
    take one MLlib fit per point and fold (``grid_by_fits``)."""
    grid = grid or GRID
    found = nested_grid(df, features, label, fold_col, grid, seed, num_folds) if set(grid) == set(GRID) else None
    return found if found is not None else grid_by_fits(df, features, label, fold_col, grid, parallelism, seed, num_folds)


def grid_by_fits(df: DataFrame, features: list[str], label: str, fold_col: str, grid: dict, parallelism: int = 4,
                 seed: int = 42, num_folds: int = 5) -> DataFrame:
    """One MLlib random forest per grid point and fold."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    pg = ParamGridBuilder()
    for name, values in grid.items():
        pg = pg.addGrid(rf.getParam(name), values)
    maps = pg.build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="recallByLabel", metricLabel=1.0)
    pipe = Pipeline(stages=[*_prep(features), rf])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism, seed=seed)
    d = _as_double(df, features, label).withColumn(fold_col, F.col(fold_col).cast("int"))
    m = cv.fit(d)
    rows = [tuple(int(pm[rf.getParam(n)]) for n in grid) + (float(score),) for pm, score in zip(maps, m.avgMetrics)]
    schema = ", ".join(f"{n} int" for n in grid) + ", mean_cv_recall double"
    return df.sparkSession.createDataFrame(rows, schema)  # one row per grid point


def learning_curve(df: DataFrame, features: list[str], label: str, key: str, fold_col: str, estimator=None,
                   fractions=tuple(i / 10 for i in range(1, 11)), seed: int = 42, num_folds: int = 5,
                   parallelism: int = 4) -> DataFrame:
    """i09: mean train and validation recall over the folds for nested training subsets (keyed-hash fraction)
    of ``estimator`` (a classifier on ``features``; default logistic regression).

    One fit per (fraction, fold), ``parallelism`` of them at a time as in ``CrossValidator``, on the columns that a
    fit reads; its two recalls are one row on the driver."""
    model = estimator or LogisticRegression(featuresCol="features", labelCol=label, maxIter=50)
    pipe = Pipeline(stages=[*_prep(features), model])
    base = _held(_as_double(df, features, label).withColumn("_u", md5_uniform(key, seed)), [*features, label, fold_col, "_u"])

    def point(fr: float, fold: int) -> tuple:
        sub = base.where((F.col(fold_col) != fold) & (F.col("_u") < fr))
        fitted = pipe.copy().fit(sub)
        scored = predict(fitted, sub.withColumn("_part", F.lit("train")).unionByName(
            base.where(F.col(fold_col) == fold).withColumn("_part", F.lit("valid"))), features, label)
        m = {r["_part"]: r for r in scored.groupBy("_part").agg(
            F.count("*").alias("n"), F.count_if((F.col(label) == 1) & (F.col("prediction") == 1)).alias("tp"),
            F.count_if(F.col(label) == 1).alias("pos")).collect()}
        recall = lambda p: m[p]["tp"] / m[p]["pos"] if p in m and m[p]["pos"] else None
        return float(fr), fold, m["train"]["n"] if "train" in m else 0, recall("train"), recall("valid")

    with ThreadPool(parallelism) as pool:
        rows = pool.starmap(inheritable_thread_target(df.sparkSession)(point), [(fr, fold) for fr in fractions for fold in range(num_folds)], 1)
    return (df.sparkSession.createDataFrame(rows, "fraction double, fold int, n_train long, train_recall double, validation_recall double")
            .groupBy("fraction").agg(F.avg("n_train").alias("n_train"), F.avg("train_recall").alias("train_recall"),
                                     F.avg("validation_recall").alias("validation_recall")))


def feature_importance(model: PipelineModel | CellForest, features: list[str]) -> DataFrame:
    """i10: tree-ensemble feature importances, sorted (one row per feature)."""
    imp = model.importances.tolist() if isinstance(model, CellForest) else model.stages[-1].featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(features, (float(x) for x in imp)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")
