"""Complexity predictor: random forest, cross-validation, sensitivity."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..sources import scratch
from .summary import correlation, cv_report, fake_simple, failures, spread_report, successes
from .threshold import ranked


def assembled(df: DataFrame, features: list[str], to: str = "features") -> DataFrame:
    """Feature vector of the columns; missing values count as 0."""
    filled = df.withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol=to).transform(filled).drop(*[f"__f{i}" for i in range(len(features))])


def forest(settings: Settings, target: str) -> RandomForestRegressor:
    """Of trees that see every row."""
    return RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", numTrees=settings.trees, maxDepth=settings.depth, featureSubsetStrategy="all", seed=settings.seed, bootstrap=False, maxBins=64, cacheNodeIds=True)


def side_by_side(spark, work, items: list, at_a_time: int) -> list:
    """``work`` of each item, in order.  A fit is a chain of small jobs, so several chains run at a time."""
    with ThreadPoolExecutor(max_workers=max(1, min(at_a_time, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


#: Up to which uniform number a row is drawn 0, 1, 2 .. times: the distribution of a Poisson count of mean 1.
DRAWN = list(accumulate(math.exp(-1) / math.factorial(n) for n in range(18)))
BAG = 100_000  # weighted rows of a tree in a task


def bags(rows: DataFrame, target: str, key: str, settings: Settings) -> DataFrame:
    """The rows that each tree draws with replacement, as ``tree, fold, features, target, weight``.

    How often a tree draws a row is a Poisson count that follows from a hash of the row's key and the tree.
    Drawn rows of the same features and fold are one row of their mean and weight: a split never parts
    them, and what they differ by among themselves adds the same to both sides of every gain.
    """
    spark = rows.sparkSession
    u = F.shiftrightunsigned(F.xxhash64(key, "tree", F.lit(settings.seed)), 11) / float(2**53)
    weight = reduce(lambda a, b: a + b, [(u >= c).cast("int") for c in DRAWN])
    drawn = rows.repartition(spark.sparkContext.defaultParallelism, "features", "fold").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1)))).withColumn("weight", weight).filter("weight > 0")
    mean = F.when(F.count(target) == F.count("*"), F.sum(F.col("weight") * F.col(target)) / F.sum("weight"))  # a missing target stays one
    return drawn.groupBy("tree", "fold", "features").agg(mean.alias(target), F.sum("weight").cast("double").alias("weight"))


def bagged(rows: DataFrame, target: str, key: str, settings: Settings) -> list[RandomForestRegressionModel]:
    """Forests of resampled rows, see ``fitted``.  Each tree is fitted to its own weighted rows, whose number is
    bounded by the different features, however many rows there are."""
    spark = rows.sparkSession
    kept = scratch.written(bags(rows, target, key, settings), "bags", "tree")
    sizes = {r["tree"]: r["count"] for r in kept.groupBy("tree").count().collect()}
    one = DecisionTreeRegressor(featuresCol="features", labelCol=target, weightCol="weight", maxDepth=settings.depth, seed=settings.seed, maxBins=64)

    def trees(tree: int) -> list:
        own = kept.filter(F.col("tree") == tree).drop("tree").coalesce(-(-sizes.get(tree, 1) // BAG)).persist()
        out = [one.fit(own if k is None else own.filter(F.col("fold") != k)) for k in [*range(settings.folds), None]]
        own.unpersist()
        return out

    grown = side_by_side(spark, trees, list(range(settings.trees)), max(settings.fits, 2 * spark.sparkContext.defaultParallelism))
    return [together(spark, list(own)) for own in zip(*grown)]


def together(spark, trees: list) -> RandomForestRegressionModel:
    """A forest of trees that were fitted one by one."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml.regression
    own = gateway.new_array(jvm.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        own[i] = tree._java_obj
    model = jvm.RandomForestRegressionModel(f"forest_{uuid.uuid4().hex[:12]}", own, trees[0].numFeatures)
    return RandomForestRegressionModel(model.set(model.numTrees(), len(trees)))


def fitted(rows: DataFrame, target: str, key: str, settings: Settings) -> list[RandomForestRegressionModel]:
    """A model of the rows outside each ``fold``, and the model of all rows."""
    if settings.resample_rows:
        return bagged(rows, target, key, settings)
    fit = lambda k: forest(settings, target).fit(rows if k is None else rows.filter(F.col("fold") != k))
    return side_by_side(rows.sparkSession, fit, [*range(settings.folds), None], settings.fits)


def folds(df: DataFrame, key: str, k: int, seed: int = 42, to: str = "fold") -> DataFrame:
    """Fold 0 .. k-1 by the rank of a hash of a stable key: sizes differ by one at most."""
    hashed = df.withColumn("__h", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))))
    return ranked(hashed, [], "__h", df.count()).withColumn(to, ((F.col("rank") - 1) % k).cast("int")).drop("__h", "rank")


def predict(model: RandomForestRegressionModel, df: DataFrame, features: list[str], to: str = "kappa_predicted") -> DataFrame:
    return model.transform(assembled(df, features)).withColumnRenamed("prediction", to).drop("features")


def importances(model: RandomForestRegressionModel, features: list[str], spark) -> DataFrame:
    """Feature importances, largest first."""
    rows = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")


def out_of_fold(rows: DataFrame, target: str, key: str, settings: Settings) -> tuple[DataFrame, RandomForestRegressionModel]:
    """``key, fold, target, prediction`` of rows with a ``features`` vector and a unique key, each row
    predicted by the model that has not seen its fold; and the model of all rows, fitted beside the others."""
    rows = folds(rows, key, settings.folds, settings.seed).select(key, "fold", F.col(target).cast("double").alias(target), "features")
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).persist()  # every level of every fit is a task for each part
    *parts, whole = fitted(rows, target, key, settings)
    out = None
    for k, model in enumerate(parts):
        part = model.transform(rows.filter(F.col("fold") == k)).select(key, "fold", target, "prediction")
        out = part if out is None else out.unionByName(part)
    out = out.persist()
    out.count()
    rows.unpersist()
    return out, whole


ROW = "__row"


def with_row_key(df: DataFrame, to: str = ROW) -> DataFrame:
    """Add a unique key that follows from a row's values: their hash and a running number among equal
    rows.  Ids may be missing or repeat, so they cannot tell rows apart."""
    value = lambda f: F.col(f"`{f.name}`") if f.dataType.typeName() not in ("variant", "map") else F.to_json(f"`{f.name}`")
    whole = F.md5(F.to_json(F.struct(*[value(f).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"}))
    number = F.row_number().over(W.partitionBy(to).orderBy(to))
    return df.withColumn(to, whole).withColumn(to, F.concat_ws("-", to, number.cast("string")))


@dataclass
class Stage1:
    model: RandomForestRegressionModel
    scored: DataFrame  # all rows with kappa_predicted and kappa_predicted_oof
    scores: DataFrame
    importances: DataFrame
    fake_simple: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what is kept in memory; the frames then compute it anew."""
        for df in self.held:
            df.unpersist()


def train(df: DataFrame, features: list[str], target: str = "kappa_actual", flag: str = "is_success", settings: Settings | None = None) -> Stage1:
    """Cross-validate and fit on the successes, score all rows.  The same held-out
    predictions give every score, so ``folds + 1`` fits are enough."""
    settings = settings or Settings()
    base = assembled(with_row_key(df), features).withColumn(target, F.col(target).cast("double")).persist()
    good = successes(base, flag)
    oof, model = out_of_fold(good, target, ROW, settings)
    scored = model.transform(base).withColumnRenamed("prediction", "kappa_predicted").drop("features").join(oof.select(ROW, F.col("prediction").alias("__oof")), ROW, "left")
    scored = scored.withColumn("kappa_predicted_oof", F.coalesce("__oof", "kappa_predicted")).drop("__oof", ROW)
    return Stage1(model, scored, cv_report(oof, target, "prediction"), importances(model, features, df.sparkSession), spread_report(fake_simple(scored, target, flag), "kappa_predicted"), [base, oof])


def sensitivity(df: DataFrame, model: RandomForestRegressionModel, features: list[str], target: str = "kappa_actual", flag: str = "is_success", settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Cross-validation on all rows, and the correlation of both models' predictions on the failures."""
    settings = settings or Settings()
    base = assembled(with_row_key(df), features).withColumn(target, F.col(target).cast("double")).persist()
    oof, full = out_of_fold(base, target, ROW, settings)
    both = full.transform(model.transform(failures(base, flag)).withColumnRenamed("prediction", "by_successes")).withColumnRenamed("prediction", "by_all")
    # a row each, kept so that the cached rows can go
    out = tuple(df.sparkSession.createDataFrame(one.collect(), one.schema) for one in (cv_report(oof, target, "prediction"), correlation(both, "by_successes", "by_all")))
    for held in (base, oof):
        held.unpersist()
    return out


def save(model: RandomForestRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestRegressionModel:
    return RandomForestRegressionModel.load(path)
