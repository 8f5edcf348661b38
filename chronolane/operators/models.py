"""Fitting, calibrating and explaining classifiers on wide tables with Spark ML."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators.metrics import auroc, average_precision, calibration_error, hash_uniform, regression
from chronolane.operators.ordered import percentiles
from chronolane.sources.catalog import written_once


def class_weights(train: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that balance the two classes; the counts are one small aggregate."""
    n, pos = train.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    pos = pos or 0
    return train.withColumn(name, F.when(F.col(label) == 1, n / (2.0 * max(1, pos))).otherwise(n / (2.0 * max(1, n - pos))))


def fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=columns)


def logistic(train: DataFrame, columns: list[str], label: str, penalty: float = 0.01, max_iter: int = 50) -> PipelineModel:
    """L2 logistic regression with balanced weights on scaled features; missing values count as 0."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=penalty, elasticNetParam=0.0, maxIter=max_iter)]
    return Pipeline(stages=stages).fit(class_weights(fill(train, columns), label))


def boosted(train: DataFrame, columns: list[str], label: str, fold: str | None = None, depths: tuple[int, ...] = (3,), trees: int = 10, seed: int = 7) -> PipelineModel:
    """Boosted trees; with a fold column the depth is chosen by cross-validation within entities."""
    base = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depths[0], seed=seed)
    data = class_weights(fill(train, columns), label)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    if not fold or len(depths) == 1:
        return Pipeline(stages=[assemble, base]).fit(data)
    grid = ParamGridBuilder().addGrid(base.maxDepth, list(depths)).build()
    folds = data.select(F.max(fold)).first()[0] + 1
    cv = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), numFolds=folds, foldCol=fold)
    best = cv.fit(assemble.transform(data)).bestModel
    return PipelineModel([assemble, best])


def forest(train: DataFrame, columns: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    """A random forest with balanced weights."""
    fitted = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), fitted]).fit(class_weights(fill(train, columns), label))


def predict(model: PipelineModel, df: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    out = model.transform(fill(df, columns)).withColumn(name, vector_to_array("probability")[1])
    return out.drop("raw", "features", "rawPrediction", "probability", "prediction")


def compare(models: dict[str, PipelineModel], df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """model, auroc over df, best first."""
    frames = [predict(m, df, columns).select(F.lit(n).alias("model"), "p", label) for n, m in models.items()]
    allp = frames[0]
    for f in frames[1:]:
        allp = allp.unionByName(f)
    return auroc(allp.withColumn("p", F.round("p", 6)), "p", label, ["model"]).orderBy(F.col("auroc").desc(), "model")


def compare_both(models: dict[str, PipelineModel], df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """model, auroc, auprc over df, the best auprc first."""
    frames = [predict(m, df, columns).select(F.lit(n).alias("model"), F.round("p", 6).alias("p"), label) for n, m in models.items()]
    every = written_once(reduce(DataFrame.unionByName, frames))
    return auroc(every, "p", label, ["model"]).join(average_precision(every, "p", label, ["model"]), "model").orderBy(F.col("auprc").desc(), "model")


def isotonic(train: DataFrame, p: str, label: str):
    return IsotonicRegression(featuresCol="__x", labelCol=label, predictionCol="__c").fit(_with_vector(train, p))


def _with_vector(df: DataFrame, p: str) -> DataFrame:
    return VectorAssembler(inputCols=[p], outputCol="__x").transform(df)


def calibrate(model, df: DataFrame, p: str, name: str = "calibrated") -> DataFrame:
    out = model.transform(_with_vector(df, p))
    return out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__c")))).drop("__x", "__c")


def pooled_points(frame: pd.DataFrame) -> tuple[list[float], list[float]]:
    """Isotonic fit of (x, n, s) by pooling adjacent violators: the ends of each block and its mean."""
    means, sizes, ends = [], [], []
    for x, n, s in frame.sort_values("x")[["x", "n", "s"]].itertuples(index=False):
        means.append(s / n)
        sizes.append(n)
        ends.append([x, x])
        while len(means) > 1 and means[-2] >= means[-1]:
            n2, m2, e2 = sizes.pop(), means.pop(), ends.pop()
            means[-1] = (means[-1] * sizes[-1] + m2 * n2) / (sizes[-1] + n2)
            sizes[-1] += n2
            ends[-1][1] = e2[1]
    xs, ys = [], []
    for m, (lo, hi) in zip(means, ends, strict=True):
        for x in (lo, hi) if hi > lo else (lo,):
            xs.append(x)
            ys.append(m)
    return xs, ys


def calibrate_by_group(df: DataFrame, fit: Column, p: str, label: str, group: str, least_rows: int, least_events: int, bins: int = 10) -> DataFrame:
    """Isotonic for all (p_global), and on top of it for each group with enough support where that lowers the calibration error on the other rows (p_served).

    All groups are fitted in one job, on counts by score to six places, so a group is at most a
    million counts; their fits are broadcast, as many as there are groups with support. Any group
    that is unknown, null or without a fit keeps the global value.
    """
    out = calibrate(isotonic(df.filter(fit), p, label), df, p, "p_global")
    cells = out.filter(fit & F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g"), F.round("p_global", 6).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("s"))
    support = cells.groupBy("g").agg(F.sum("n").alias("rows"), F.sum("s").alias("events")).filter((F.col("rows") >= least_rows) & (F.col("events") >= least_events))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pooled_points(frame)
        return pd.DataFrame({"g": frame["g"].iloc[:1], "xs": [xs], "ys": [ys]})

    found = cells.join(support.select("g"), "g", "left_semi").groupBy("g").applyInPandas(fitted, "g string, xs array<double>, ys array<double>").toPandas()
    sent = df.sparkSession.sparkContext.broadcast({g: (np.array(xs), np.array(ys)) for g, xs, ys in found.itertuples(index=False)})

    @F.pandas_udf("double")
    def own(groups: pd.Series, values: pd.Series) -> pd.Series:
        served = pd.Series(np.nan, index=values.index)
        for g, at in groups.groupby(groups).groups.items():
            if g in sent.value:
                served[at] = np.clip(np.interp(values[at], *sent.value[g]), 0, 1)
        return served.astype(object).where(served.notna(), None)

    tried = out.withColumn("__own", own(F.col(group).cast("string"), F.col("p_global")))
    rest = tried.filter(~fit & F.col("__own").isNotNull()).withColumn("__g", F.col(group).cast("string"))
    errors = calibration_error(rest, "__own", label, bins, ["__g"]).withColumnRenamed("ece", "__a").join(calibration_error(rest, "p_global", label, bins, ["__g"]), "__g")
    better = [r["__g"] for r in errors.filter("__a < ece").collect()]
    return tried.withColumn("p_served", F.when(F.col(group).cast("string").isin(better), F.col("__own")).otherwise(F.col("p_global"))).drop("__own")


def two_stage_duration(train: DataFrame, columns: list[str], duration: str, q: float = 0.75, trees: int = 5):
    """The training quantile, a classifier of longer stays, and a regressor fitted on the shorter ones."""
    cut = percentiles(train, [], duration, {"cut": q}).first()[0]
    long = boosted(train.withColumn("is_long", (F.col(duration) > cut).cast("int")), columns, "is_long", trees=trees)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    short = Pipeline(stages=[assemble, GBTRegressor(featuresCol="features", labelCol=duration, maxIter=trees, maxDepth=3, seed=7)]).fit(fill(train.filter(F.col(duration) <= cut), columns))
    return cut, long, short


def evaluate_duration(fitted, test: DataFrame, columns: list[str], duration: str) -> DataFrame:
    """subset, n, accuracy, auroc of the classifier; mae, rmse, r2 of the regressor on the stays that are short, and on those taken as short."""
    cut, long, short = fitted
    p = predict(long, test.filter(F.col(duration).isNotNull()), columns, "p_long")
    g = written_once(short.transform(p).select(F.col(duration).cast("double").alias("truth"), F.col("prediction").alias("guess"), F.round("p_long", 6).alias("p_long"), (F.col(duration) > cut).cast("int").alias("is_long")))
    taken = F.col("p_long") >= 0.5
    x = g.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("is_long") == 0, "actual_short"), F.when(~taken, "predicted_short")))))
    base = x.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((taken.cast("int") == F.col("is_long")).cast("int")), 6).alias("accuracy"))
    return base.join(auroc(x, "p_long", "is_long", ["subset"]), "subset", "left").join(regression(x.filter("subset <> 'all'"), "truth", "guess", ["subset"]), "subset", "left")


def project(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with embedding array<double>: a fitted linear projection to k dimensions."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pca")]
    full = fill(df, columns)
    out = Pipeline(stages=stages).fit(full).transform(full)
    return out.withColumn("embedding", vector_to_array("pca")).drop("raw", "scaled", "pca")


def linear_contributions(df: DataFrame, key: str, weights: dict[str, float], means: DataFrame) -> DataFrame:
    """key, feature, contribution: weight times distance from the training mean, long form."""
    m = df.crossJoin(F.broadcast(means))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.lit(w) * (F.col(c) - F.col(f"mean_{c}")), 6).alias("contribution")) for c, w in weights.items()))
    return m.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def scenarios(df: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Each row under each scenario (scenario and one nullable column `set_<c>` for each column); the table of scenarios is small by contract."""
    out = df.crossJoin(overrides)
    return out.withColumns({c: F.coalesce(F.col(f"set_{c}"), F.col(c)) for c in columns})


def withheld(scores: DataFrame, fidelity: DataFrame, floor: float = 2 / 3) -> DataFrame:
    """scores (..., task, p) with p null where a task is withheld, and reason (null where it is served).

    fidelity: task, reference and reduced, the AUROC of the full input and of the input at hand; one
    row for each task. A task is served if the input keeps at least `floor` of the lift over chance.
    """
    lift = F.when(F.col("reference") > 0.5, (F.col("reduced") - 0.5) / (F.col("reference") - 0.5)).otherwise(0.0)
    f = fidelity.select("task", lift.alias("__kept"))
    reason = F.when(F.col("__kept").isNull(), "not measured").when(F.col("__kept") <= 0, "below chance").when(F.col("__kept") < floor, "below floor")
    return scores.join(f, "task", "left").withColumn("reason", reason).withColumn("p", F.when(F.col("reason").isNull(), F.col("p"))).drop("__kept")


def triplets(codes: DataFrame, entity: str, code: str, share: float, seed: int = 0, bucket: int = 64, draws: int = 4) -> DataFrame:
    """anchor, positive (shares a code with it), negative (shares none) for a hashed share of the entities.

    Entities lie in hash buckets of about `bucket` members, within each code and over all. An anchor
    looks into one bucket of each of its codes and into `draws` of all, and takes the first of its
    own hash order, so members of a frequent code are never paired with each other. Either
    partner is null where those buckets hold none; null entities and codes are passed over.
    """
    slot = lambda name, *parts: F.floor(hash_uniform(F.lit(f"{name}{seed}"), *parts) * F.col("__b")).cast("long").alias("__slot")
    pick = F.min(F.struct(hash_uniform(F.lit(f"pick{seed}"), "anchor", "__e").alias("h"), "__e"))
    c = codes.select(F.col(entity).alias("__e"), F.col(code).alias("__c")).dropna().distinct()
    sized = c.join(c.groupBy("__c").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("__b")), "__c")
    chosen = hash_uniform(F.lit(f"anchor{seed}"), "__e") < share
    asked = sized.filter(chosen).select(F.col("__e").alias("anchor"), "__c", slot("ask", "__e", "__c"))
    near = asked.join(sized.select("__e", "__c", slot("member", "__e", "__c")), ["__c", "__slot"]).filter("anchor <> __e")
    near = near.groupBy("anchor").agg(pick.alias("m")).select("anchor", F.col("m.__e").alias("positive"))
    sets = c.groupBy("__e").agg(F.collect_set("__c").alias("__s"))
    sets = sets.withColumn("__b", F.lit(-(-sets.count() // bucket)))
    anchors = sets.filter(chosen).select(F.col("__e").alias("anchor"), F.col("__s").alias("__a"), "__b")
    drawn = anchors.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("anchor", "__a", slot("draw", "anchor", "__d")).distinct()
    far = drawn.join(sets.select("__e", "__s", slot("all", "__e")), "__slot").filter(~F.arrays_overlap("__a", "__s"))
    far = far.groupBy("anchor").agg(pick.alias("m")).select("anchor", F.col("m.__e").alias("negative"))
    return anchors.select("anchor").join(near, "anchor", "left").join(far, "anchor", "left")
