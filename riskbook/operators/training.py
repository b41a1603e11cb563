"""Training, calibration, scoring and studies with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, Normalizer, OneHotEncoder, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation, splits
from .attribution import leaves, tree_arrays
from .staging import staged

LOW, HIGH = 1e-4, 1 - 1e-4
MEMBERS = ("gbt", "forest", "logistic")
FOLDS = "folds"  # the seed of training folds: not that of other draws from the same keys, with which folds would be correlated


def feature_stages(numeric: list[str], categorical: list[str]) -> list:
    """Impute, encode and assemble: fitted once, applied to any table of the same columns."""
    stages = [Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median")]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])]
    return [*stages, VectorAssembler(inputCols=[f"{c}_f" for c in numeric] + [f"{c}_v" for c in categorical], outputCol="features")]


def member(name: str, label: str, trees: int, depth: int):
    common = {"labelCol": label, "weightCol": "_weight", "probabilityCol": f"{name}_prob", "rawPredictionCol": f"{name}_raw", "predictionCol": f"{name}_pred"}
    if name == "gbt":
        named = {k: common[k] for k in ("labelCol", "weightCol", "predictionCol")}
        # each tree sees a share of rows, each node of columns
        sampled = {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20}
        return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, **sampled, **named).setProbabilityCol(common["probabilityCol"]).setRawPredictionCol(common["rawPredictionCol"])
    if name == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, **common)
    return LogisticRegression(regParam=0.01, **common)


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Positives weigh as many times as there are more negatives."""
    ratio = df.agg(F.greatest(F.lit(1.0), F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))).alias("_ratio")).first()["_ratio"]
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(ratio or 1.0))).otherwise(1.0))


def clip(p: Column) -> Column:
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), p))


def with_members(model: PipelineModel, df: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """df with a probability p_<member> for each member and their mean p_raw."""
    out = model.transform(df)
    kept = [c for c in df.columns if c != "features"]
    out = out.withColumns({f"p_{m}": vector_to_array(f"{m}_prob")[1] for m in members})
    return out.withColumn("p_raw", sum((F.col(f"p_{m}") for m in members), F.lit(0.0)) / len(members)).select(*kept, *[f"p_{m}" for m in members], "p_raw", "features")


class Bundle:
    """A fitted ensemble with its calibration."""

    def __init__(self, model: PipelineModel | None, calibrator, members: tuple[str, ...], constant: float | None = None):
        self.model, self.calibrator, self.members, self.constant = model, calibrator, members, constant

    def score(self, df: DataFrame) -> DataFrame:
        """df with p_<member>, p_raw and the calibrated p, all distributed."""
        if self.constant is not None:
            return df.withColumns({c: F.lit(self.constant) for c in [*(f"p_{m}" for m in self.members), "p_raw"]} | {"p": clip(F.lit(self.constant))})
        out = with_members(self.model, df, self.members)
        calibrated = self.calibrator.transform(out.withColumn("_iso", F.col("p_raw")))
        return calibrated.withColumn("p", clip(F.col("calibrated"))).drop("_iso", "calibrated", "features")

    def arrays(self, path: str) -> dict:
        """What p is computed from, as a bounded number of arrays; the trees are read from models saved below path."""
        out: dict = {"members": list(self.members), "constant": self.constant}
        if self.constant is None:
            for m, fitted in zip(self.members, self.model.stages[1:]):
                out[m] = (fitted.coefficients.toArray(), fitted.intercept) if m == "logistic" else tree_arrays(fitted, f"{path}/{m}")
            out["steps"] = self.calibrator.boundaries.toArray(), self.calibrator.predictions.toArray()
        return out

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Writes the bundle into a folder that Spark can reach: what it consists of as JSON, beside it the fitted parts."""
        spark = spark or SparkSession.active()
        state = json.dumps({"members": list(self.members), "constant": self.constant})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
            self.calibrator.write().overwrite().save(f"{path}/calibrator")

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> Bundle:
        """The bundle that save() wrote."""
        state = json.loads((spark or SparkSession.active()).read.text(f"{path}/state").first()["value"])
        if state["constant"] is not None:
            return Bundle(None, None, tuple(state["members"]), state["constant"])
        return Bundle(PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/calibrator"), tuple(state["members"]))


def scores_of(arrays: dict, x: np.ndarray) -> np.ndarray:
    """The calibrated p of rows of features without gaps, by Bundle.arrays(): as Bundle.score, but for the last bits."""
    if arrays["constant"] is not None:
        return np.full(len(x), min(max(arrays["constant"], LOW), HIGH))
    parts = []
    for m in arrays["members"]:
        if m == "gbt":
            parts.append(1 / (1 + np.exp(-2 * sum(t["value"][leaves(t, x)] for t in arrays[m]))))
        elif m == "forest":
            parts.append(sum(t["share"][leaves(t, x)] for t in arrays[m]) / len(arrays[m]))
        else:
            parts.append(1 / (1 + np.exp(-(x @ arrays[m][0] + arrays[m][1]))))
    return np.clip(np.interp(sum(parts) / len(parts), *arrays["steps"]), LOW, HIGH)


def scorer(arrays: dict):
    """A function of a struct of features that gives p, batch by batch."""

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(scores_of(arrays, rows.to_numpy(np.float64)))

    return score


def fit(df: DataFrame, label: str, key: str, numeric: list[str], categorical: list[str], members: tuple[str, ...] = MEMBERS, trees: int = 15, depth: int = 4) -> tuple[Bundle, DataFrame]:
    """Fits members on the fit fold and calibration on the calibration fold; returns the bundle and df with its fold, and
    `evaluated` for the rows that metrics are taken on (the calibration fold of a small table).

    The folds and the assembled features are written once; every member reads these. With one class only, the bundle gives
    the base rate.
    """
    folded = staged(splits.split_for(staged(df.where(F.col(label).isNotNull())), label, key, FOLDS))
    return fit_folded(folded, label, numeric, categorical, members, trees, depth), folded


def fit_folded(folded: DataFrame, label: str, numeric: list[str], categorical: list[str], members: tuple[str, ...] = MEMBERS, trees: int = 15, depth: int = 4) -> Bundle:
    """As fit(), of a written table that has its folds. A single member assembles the features as it reads."""
    rate = folded.agg(F.avg(label).alias("rate")).first()["rate"]
    if rate is None or rate in (0.0, 1.0):
        return Bundle(None, None, members, float(rate or 0.0))
    features = Pipeline(stages=feature_stages(numeric, categorical)).fit(folded.where("fold = 'fit'"))
    ready = features.transform(folded.where("fold <> 'test'")).select(F.col(label).cast("double").alias(label), "fold", "features")
    ready = staged(ready) if len(members) > 1 else ready
    train = weighted(ready.where("fold = 'fit'"), label).drop("fold")
    fitted = [member(m, label, trees, depth).fit(train) for m in members]
    model = PipelineModel(stages=[features, *fitted])
    cal = with_members(PipelineModel(stages=fitted), ready.where("fold = 'cal'"), members).withColumn("_iso", F.col("p_raw"))
    calibrator = IsotonicRegression(featuresCol="_iso", labelCol=label, predictionCol="calibrated").fit(cal.select("_iso", label))
    return Bundle(model, calibrator, members)


def degenerate_metrics(rate: float) -> dict[str, float]:
    """What the metrics are where there is one class only."""
    return {"auc": 0.5, "gini": 0.0, "pr_auc": rate, "brier": rate * (1 - rate), "ece": 0.0}


def metrics_by_variant(scored: DataFrame, label: str, variants: list[str]) -> DataFrame:
    """All metrics of each score column, as rows."""
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("p")) for v in variants])
    long = scored.select(F.col(label).cast("int").alias("y"), F.explode(cells).alias("c")).select("y", "c.*")
    return evaluation.round_all(evaluation.evaluate(long, ["variant"]), ["base_rate", "auc", "gini", "pr_auc", "brier", "ece"], 5)


def leave_one_out(df: DataFrame, corpus: str, label: str, key: str, numeric: list[str], least: int = 50, members: tuple[str, ...] = MEMBERS, trees: int = 10) -> DataFrame:
    """Each corpus scored by a model of all others; corpora of one class or few rows are left out. The folds of all models are
    dealt and written together."""
    df = staged(df.select(corpus, label, key, *numeric))
    sizes = df.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")).where(f"n >= {least} AND classes = 2")
    out = df.sparkSession.createDataFrame([], "held_out string, y double, p double")
    names = sorted(r[corpus] for r in sizes.collect())  # one model a corpus
    folded = staged(splits.splits_without(df.where(F.col(label).isNotNull()), label, key, corpus, names, FOLDS)) if names else df
    others = lambda k: fit_folded(folded.where(F.col(f"_fold_{k}").isNotNull()).withColumn("fold", F.col(f"_fold_{k}")), label, numeric, [], members, trees)
    with ThreadPoolExecutor(4) as pool:  # their small jobs run side by side
        bundles = list(pool.map(others, range(len(names))))
    for name, bundle in zip(names, bundles):
        out = out.unionByName(bundle.score(df.where(F.col(corpus) == name)).select(F.col(corpus).cast("string").alias("held_out"), F.col(label).cast("double").alias("y"), F.col("p").cast("double").alias("p")))
    return evaluation.round_all(evaluation.auc(out, ["held_out"]), ["auc", "gini"], 5)


def linear_probe(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """AUC of a logistic regression on frozen vectors, 70/30 by class."""
    from pyspark.ml.functions import array_to_vector

    rows = splits.three_way_split(df, label, key, (0.7, 0.7)).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(labelCol=label, regParam=0.01, maxIter=30).fit(rows.where("fold = 'fit'"))
    test = model.transform(rows.where("fold = 'test'")).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
    return evaluation.round_all(evaluation.auc(test), ["auc", "gini"], 5)


def embed_sequences(store: DataFrame, client: str, size: int = 32, tasks: int | None = None) -> DataFrame:
    """A unit vector for each client with an event, from its events' tokens (mean-pooled Word2Vec, fitted by `tasks` tasks: by
    default one for each 200,000 clients)."""
    word = lambda e: F.concat_ws("_", e["amt"].cast("string"), e["channel"].cast("string"), e["dt_bucket"].cast("string"))
    words = store.select(client, F.transform("events", word).alias("words"))
    words = staged(words)
    tasks = tasks or max(1, words.count() // 200_000)
    w2v = Word2Vec(vectorSize=size, minCount=1, numPartitions=tasks, maxIter=1, seed=7, inputCol="words", outputCol="v")
    model = Pipeline(stages=[w2v, Normalizer(inputCol="v", outputCol="unit")]).fit(words)
    return model.transform(words).select(client, vector_to_array("unit").alias("embedding"))


def ablation(df: DataFrame, label: str, key: str, tabular: list[str], sequence: list[str], least: int = 100, members: tuple[str, ...] = ("gbt",), trees: int = 10) -> DataFrame:
    """Metrics on the evaluated rows of tabular, sequence and both sets of columns, and the lift in AUC of both over tabular;
    no row with under `least` rows."""
    df = staged(df.select(key, label, *tabular, *sequence))
    out = df.sparkSession.createDataFrame([], "variant string, y double, p double")
    if df.count() >= least:
        for name, columns in (("tabular", tabular), ("sequence", sequence), ("both", tabular + sequence)):
            bundle, folded = fit(df, label, key, columns, [], members, trees)
            out = out.unionByName(bundle.score(folded.where("evaluated")).select(F.lit(name).alias("variant"), F.col(label).cast("double").alias("y"), F.col("p").cast("double").alias("p")))
    both = evaluation.evaluate(staged(out), ["variant"])
    base = both.where("variant = 'tabular'").select(F.col("auc").alias("_base"))
    lifted = both.crossJoin(F.broadcast(base)).withColumn("lift", F.col("auc") - F.col("_base")).drop("_base")
    return evaluation.round_all(lifted, ["base_rate", "auc", "gini", "pr_auc", "brier", "ece", "lift"], 5)
