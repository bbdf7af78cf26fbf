"""Learned routers: character n-gram TF-IDF with balanced multinomial logistic regression, in Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .routing import BACKENDS


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word between blanks."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w: Column) -> Column:
        each = [F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i, n=n: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.flatten(F.array(*each))

    return F.flatten(F.transform(padded, of_word))


def with_class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: the same total for each label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(counts, label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def fit_text_router(rows: DataFrame, label: str = "gold", vocabulary: int = 1 << 16, reg: float = 0.01) -> PipelineModel:
    d = with_class_weights(rows.withColumn("grams", char_grams(F.col("question"))), label)
    stages = [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary),
        IDF(inputCol="tf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="features"),
        LogisticRegression(family="multinomial", regParam=reg, weightCol="weight", maxIter=60),
    ]
    return Pipeline(stages=stages).fit(d)


def predict_routes(model: PipelineModel, questions: DataFrame, label: str = "gold") -> DataFrame:
    """qid, predicted, p_<backend> (0 for a backend that was not among the labels)."""
    labels = list(model.stages[0].labels)
    d = questions.withColumn("grams", char_grams(F.col("question")))
    for s in model.stages[1:]:
        d = s.transform(d)
    p = vector_to_array("probability")
    shares = {f"p_{b}": (F.get(p, labels.index(b)) if b in labels else F.lit(0.0)) for b in BACKENDS}
    best = F.get(F.array(*(F.lit(x) for x in labels)), F.col("prediction").cast("int"))
    return d.select("*", best.alias("predicted"), *(v.alias(k) for k, v in shares.items()))


def folds(rows: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Adds fold: each label's rows, in the order of a hash, dealt to k folds in turn."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % k)


def out_of_fold(rows: DataFrame, k: int = 4, seed: int = 13, label: str = "gold") -> DataFrame:
    """qid, gold, fold, predicted: each row by a model that has not seen it."""
    d = folds(rows, label, "qid", k, seed)
    out = None
    for i in range(k):
        model = fit_text_router(d.filter(F.col("fold") != i).drop("fold"), label)
        part = predict_routes(model, d.filter(F.col("fold") == i), label).select("qid", label, "fold", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def fit_linear(features: DataFrame, label: str, names: tuple[str, ...], c: float, binary: bool = False) -> DataFrame:
    """label, feature, weight: a balanced logistic model with inverse regularisation ``c`` over named columns."""
    from pyspark.ml.feature import VectorAssembler

    d = with_class_weights(features, label)
    n = max(1, d.count())
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(d)
    d = VectorAssembler(inputCols=list(names), outputCol="_x").transform(indexer.transform(d))
    m = LogisticRegression(labelCol="_label", featuresCol="_x", weightCol="weight", family="binomial" if binary else "multinomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=100).fit(d)
    labels = list(indexer.labels)[1:] if binary else list(indexer.labels)
    rows = [(lab, f, float(m.coefficientMatrix[i, j])) for i, lab in enumerate(labels) for j, f in enumerate(names)]
    rows += [(lab, "intercept", float(m.interceptVector[i])) for i, lab in enumerate(labels)]
    return features.sparkSession.createDataFrame(rows, "label string, feature string, weight double")


def top_weights(weights: DataFrame, n: int = 10) -> DataFrame:
    """The n largest weights of each label by magnitude."""
    w = Window.partitionBy("label").orderBy(F.desc(F.abs("weight")), "feature")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# -- the evidence model: one binary model over the candidates of questions ---------------


def evidence_model(pairs: DataFrame, names: tuple[str, ...], c: float = 0.7) -> tuple[dict[str, float], float]:
    """Weights and intercept of a balanced logistic model of label (0, 1) over named columns of candidate rows.

    The optimum of sum(weight * loss) / n + |beta|^2 / (2 c n), with the same total weight for
    both labels and a free intercept; it is unique, so it does not depend on the solver.
    """
    from pyspark.ml.feature import VectorAssembler

    d = with_class_weights(pairs.select(*names, "label"), "label")
    n = max(1, d.count())
    x = VectorAssembler(inputCols=list(names), outputCol="_x").transform(d).select("_x", "label", "weight")
    m = LogisticRegression(labelCol="label", featuresCol="_x", weightCol="weight", family="binomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=1000, tol=1e-11).fit(x)
    return dict(zip(names, map(float, m.coefficients), strict=True)), float(m.intercept)


def model_gradient(pairs: DataFrame, weights: dict[str, float], intercept: float, c: float = 0.7) -> DataFrame:
    """feature, gradient of evidence_model()'s objective at given weights: zero everywhere at the optimum. One pass."""
    d = with_class_weights(pairs.select(*weights, "label"), "label")
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.col(name) * w
    off = F.col("weight") * (1 / (1 + F.exp(-z)) - F.col("label"))
    sums = d.withColumn("_off", off).agg(F.count("*").alias("_n"), F.avg("_off").alias("intercept"), *(F.avg(F.col("_off") * F.col(f)).alias(f) for f in weights))
    each = [F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("gradient"))]
    each += [F.struct(F.lit(f).alias("feature"), (F.col(f) + w / (c * F.col("_n"))).alias("gradient")) for f, w in weights.items()]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.feature", "x.gradient")


def group_folds(rows: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Adds fold by a hash of the group, so that all rows of a group share one; no row is moved."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int"))


def evidence_routes_out_of_fold(pairs: DataFrame, names: tuple[str, ...], k: int = 4, seed: int = 71, c: float = 0.7) -> DataFrame:
    """qid, fold and the columns of evidence_routes(): each question's candidates scored by a model that saw none of them.

    ``pairs`` are four candidate rows a question (evidence_training_pairs()), given written.
    """
    from .diagnostics import evidence_routes

    d = group_folds(pairs, "qid", k, seed)
    out = None
    for i in range(k):
        weights, intercept = evidence_model(d.filter(F.col("fold") != i), names, c)
        part = evidence_routes(d.filter(F.col("fold") == i), weights, intercept).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
