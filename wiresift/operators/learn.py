"""Supervised and unsupervised models on feature tables, with Spark ML.

Feature tables hold one double column per feature, or one array column that is turned into a vector. Models are small
(a weight per feature); rows never leave the executors.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.operators import metrics as me
from wiresift.operators.features import check_features
from wiresift.session import pinned

BENIGN = "Benign"


def assemble(df: DataFrame, columns: Sequence[str] | None = None, array: str | None = None, out: str = "features") -> DataFrame:
    """One vector column from feature columns (leak-checked) or from an array column."""
    if array is not None:
        return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))
    check_features(columns)
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def _class_weights(df: DataFrame, label: str, power: float) -> DataFrame:
    """(N / n_c) ** power per class: one row per class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    return n.join(F.broadcast(total), F.lit(True)).select(label, F.pow(F.col("_all") / F.col("_n"), power).alias("weight"))


def fit_binary(train: DataFrame, label: str = "y", power: float = 1.0, reg: float = 1e-4):
    """Standardise, then logistic regression with inverse-frequency weights."""
    w = train.join(F.broadcast(_class_weights(train, label, power)), label)
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", standardization=False, regParam=reg, maxIter=100)
    return Pipeline(stages=[_scaler(), lr]).fit(w)


def binary_score(model, df: DataFrame, out: str = "score") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "scaled")


def logistic_baseline(df: DataFrame, columns: Sequence[str], family: str, label: str = "label", split: str = "split", budgets: Sequence[float] = (1e-3, 1e-4, 3e-5)) -> DataFrame:
    """A family against the rest: test PR-AUC and the confusion at each calibration budget and at the best F1."""
    d = assemble(df, columns).withColumns({"y": (F.col(label) == family).cast("double"), "positive": F.col(label) == family, "attack": F.col(label) != BENIGN})
    # read by the weights, the scaler, the fit and the scores
    d = pinned(d.select("features", "y", "positive", "attack", split))
    model = fit_binary(d.where(F.col(split) == 0))
    s = pinned(binary_score(model, d).withColumn("family", F.lit(family)).select("family", split, "score", "positive", "attack"))
    th = me.budget_threshold(s.where((F.col(split) == 1) & ~F.col("attack")), ["family"], budgets).select("family", F.concat(F.lit("budget "), F.col("budget").cast("string")).alias("point"), "threshold")
    f1 = me.pr_threshold(s.where(F.col(split) == 1), ["family"]).select("family", F.lit("best f1").alias("point"), "threshold")
    test = s.where(F.col(split) == 2)
    j = test.where("positive OR NOT attack").join(F.broadcast(th.unionByName(f1)), "family")
    alert = F.col("score") >= F.col("threshold")
    c = j.groupBy("family", "point", "threshold").agg(
        F.count(F.when(alert & F.col("positive"), 1)).alias("tp"), F.count(F.when(alert & ~F.col("positive"), 1)).alias("fp"), F.count(F.when(~alert & F.col("positive"), 1)).alias("fn"))
    ap = me.average_precision(test.where("positive OR NOT attack"), ["family"])
    return c.join(ap, "family")


def family_head(df: DataFrame, families: Sequence[str], label: str = "label", split: str = "split", key: str = "position", reg: float = 1e-3) -> DataFrame:
    """Multinomial head, benign first, weights sqrt(N / n_c); long scores per family with the calibration rows marked.

    Fitted on four fifths of the training rows (by key hash); the rest joins validation for calibration.
    """
    classes = [BENIGN, *families]
    code = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    held = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    d = df.withColumns({"y": code[F.col(label)], "attack": F.col(label) != BENIGN, "calib": (F.col(split) == 1) | ((F.col(split) == 0) & held)})
    fit = d.where((F.col(split) == 0) & ~held & F.col("y").isNotNull())
    fit = fit.join(F.broadcast(_class_weights(fit, "y", 0.5)), "y")
    lr = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", family="multinomial", standardization=False, regParam=reg, maxIter=100)
    model = Pipeline(stages=[_scaler(), lr]).fit(fit)
    p = model.transform(d).withColumn("_p", vector_to_array("probability"))
    return p.select(key, label, split, "calib", "attack", F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), F.col("_p")[i + 1].alias("score"), (F.col(label) == f).alias("positive")) for i, f in enumerate(families)])))


def head_report(scores: DataFrame, budgets: Sequence[float] = (1e-3, 1e-4, 6e-5, 3e-5), split: str = "split") -> DataFrame:
    """Per family and budget: threshold from benign calibration rows and the test confusion there."""
    th = me.budget_threshold(scores.where("calib AND NOT attack"), ["family"], budgets)
    test = scores.where((F.col(split) == 2) & (F.col("positive") | ~F.col("attack"))).join(F.broadcast(th), "family")
    alert = F.col("score") >= F.col("threshold")
    return test.groupBy("family", "budget", "threshold").agg(
        F.count(F.when(alert & F.col("positive"), 1)).alias("tp"), F.count(F.when(alert & ~F.col("positive"), 1)).alias("fp"), F.count(F.when(~alert & F.col("positive"), 1)).alias("fn"))


def linear_compressor(df: DataFrame, fit_on: Column, width: int = 32) -> DataFrame:
    """Project standardised features on the leading directions of benign training rows; `recon_error` is the row's squared error."""
    model = Pipeline(stages=[_scaler(), PCA(k=width, inputCol="scaled", outputCol="z")]).fit(df.where(fit_on))
    pc = model.stages[1].pc.toArray()
    out = model.transform(df)
    x, z = vector_to_array("scaled"), vector_to_array("z")
    # The directions are orthonormal: what the projection loses is |x|^2 - |z|^2 around the fitted mean.
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    assert pc.shape[1] == width
    return out.withColumns({"recon_error": F.greatest(norm(x) - norm(z), F.lit(0.0)), "z": z}).drop("scaled")


def gate_combine(df: DataFrame, classifier: str, gate: str, positive: str, calib: Column) -> DataFrame:
    """A two-feature logistic fit on calibration rows only; its score for every row. The gate's weight may come out as zero."""
    d = VectorAssembler(inputCols=[classifier, gate], outputCol="features").transform(df).withColumn("y", F.col(positive).cast("double"))
    return binary_score(fit_binary(d.where(calib), reg=0.0), d, "combined").drop("features", "y")


def platt_and_isotonic(df: DataFrame, probability: str = "p", truth: str = "truth", *, first_half: Column) -> DataFrame:
    """Fit both recalibrations on the rows of `first_half` (the earlier forecasts) and report raw and recalibrated error on the second."""
    p = F.greatest(F.least(F.col(probability), F.lit(1 - 1e-6)), F.lit(1e-6))
    d = df.withColumns({"p": p, "y": F.col(truth).cast("double")}).withColumn("logit", F.log(F.col("p") / (1 - F.col("p"))))
    fit, check = d.where(first_half), d.where(~first_half)
    lr = LogisticRegression(featuresCol="_f", labelCol="y", standardization=False, maxIter=200)
    platt = lr.fit(VectorAssembler(inputCols=["logit"], outputCol="_f").transform(fit.select("logit", "y")))
    iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(fit.select("p", "y"))
    out = iso.transform(check).withColumnRenamed("prediction", "isotonic")
    a, b = float(platt.coefficients[0]), float(platt.intercept)
    out = out.withColumn("platt", 1 / (1 + F.exp(-(a * F.col("logit") + b))))
    long = out.select("y", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("q")) for n, c in (("raw", "p"), ("platt", "platt"), ("isotonic", "isotonic"))])))
    return me.calibration(long, ["method"], "q", F.col("y") == 1, bins=10, right_closed=False)


def probe(df: DataFrame, label: str, train: Column, key: str = "vec_id") -> DataFrame:
    """A plain classifier on frozen embeddings: threshold from a fifth of the fitting rows, F1, AUROC and PR-AUC on the rest."""
    d = df.withColumns({"y": F.col(label).cast("double"), "positive": F.col(label) == 1, "_held": F.pmod(F.xxhash64(key), F.lit(5)) == 0})
    s = binary_score(fit_binary(d.where(train & ~F.col("_held"))), d).withColumn("probe", F.lit("embedding")).select("probe", "score", "positive", "_held", train.alias("_train"))
    th = me.pr_threshold(s.where("_train AND _held"), ["probe"]).select("probe", "threshold")
    test = s.where("NOT _train")
    alert = F.col("score") >= F.col("threshold")
    c = test.join(F.broadcast(th), "probe").groupBy("probe").agg(
        F.count(F.when(alert & F.col("positive"), 1)).alias("tp"), F.count(F.when(alert & ~F.col("positive"), 1)).alias("fp"), F.count(F.when(~alert & F.col("positive"), 1)).alias("fn"))
    c = c.withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))
    return c.join(me.auroc(test, ["probe"]), "probe").join(me.average_precision(test, ["probe"]), "probe")


def linear_attribution(model, df: DataFrame, flow_width: int, key: str) -> DataFrame:
    """Signed share of a binary head's decision from the flow's own columns and from its context columns."""
    coef = [float(c) for c in model.stages[-1].coefficients]
    x = vector_to_array("scaled")
    part = lambda lo, hi: reduce(lambda a, b: a + b, [x[i] * coef[i] for i in range(lo, hi)], F.lit(0.0))
    d = model.transform(df).withColumns({"from_flow": part(0, flow_width), "from_context": part(flow_width, len(coef)), "probability_": vector_to_array("probability")[1]})
    return d.select(key, F.col("probability_").alias("probability"), "from_flow", "from_context",
                    (F.abs("from_context") / (F.abs("from_context") + F.abs("from_flow") + 1e-12)).alias("context_share"))


def _triangles(width: int, mean: Sequence[float] | None):
    """Rows of vectors to the rows of their triangular QR factor, a bounded block at a time; `mean` is taken off first where it is given."""
    def factor(batches):
        held, rows, r = [], 0, None
        fold = lambda parts: np.linalg.qr(np.vstack(parts), mode="r")
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
            held.append(x if mean is None else x - np.asarray(mean))
            rows += len(x)
            if rows > 2 * width:
                r, held, rows = fold([*([] if r is None else [r]), *held]), [], 0
        if held or r is not None:
            r = fold([*([] if r is None else [r]), *held])
            for low in range(0, len(r), 256):
                part = np.ascontiguousarray(r[low:low + 256])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, part.size + 1, width, dtype=np.int32), pa.array(part.ravel()))], names=["x"])
    return factor


def singular_values(df: DataFrame, array: str, width: int, mean: Sequence[float] | None = None) -> np.ndarray:
    """Singular values of the matrix whose rows are `array` (less `mean`), by a tree of QR factors.

    Each task folds its rows into one triangle of at most width x width numbers; triangles are dealt to a quarter of the tasks until one is left.
    A triangle has the singular values of the rows below it, so nothing is squared, sampled or cut at some width; one triangle reaches the driver.
    """
    rows = pinned(df.select(F.col(array).cast("array<double>").alias("x")).mapInArrow(_triangles(width, mean), "x array<double>"))
    n = rows.count()
    while n > width:
        rows = pinned(rows.repartition(max(1, n // (4 * width))).mapInArrow(_triangles(width, None), "x array<double>"))
        n = rows.count()
    r = np.array([x[0] for x in rows.collect()], float).reshape(-1, width)
    return np.linalg.svd(r, compute_uv=False)


def representation_quality(df: DataFrame, array: str, attack: str) -> DataFrame:
    """Effective rank of the centred matrix (exp of the entropy of its normalised singular values) and separability along the mean difference.

    All rows with a vector are read, none sampled; any width will do, at width x width numbers a task. Rows without a vector take no part; vectors of
    different lengths are an error. With one class only, or no rows, separability is null; without rows the width is 0 and the ranks are null.
    """
    spark, schema = df.sparkSession, "width int, effective_rank double, rank_fraction double, separability double"
    d = df.where(F.col(array).isNotNull()).select(F.col(array).cast("array<double>").alias("x"), F.col(attack).alias("a"))
    least, width = d.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not width:
        return spark.createDataFrame([(0, None, None, None)], schema)
    if least != width:
        raise ValueError(f"vectors of {least} to {width} components")
    v = d.select(array_to_vector("x").alias("v"), "a")
    by_class = {r[0]: (r[1], r[2].toArray()) for r in v.groupBy("a").agg(F.count(F.lit(1)), Summarizer.mean(F.col("v"))).collect()}
    n = sum(c for c, _ in by_class.values())
    mean = sum(c / n * m for c, m in by_class.values())
    sv = singular_values(d, "x", width, mean.tolist())
    share = np.clip(sv / max(sv.sum(), 1e-12), 1e-12, None)
    rank = float(np.exp(-(share * np.log(share)).sum()))
    if True not in by_class or False not in by_class:
        return spark.createDataFrame([(width, rank, rank / width, None)], schema)
    direction = by_class[True][1] - by_class[False][1]
    direction = (direction / max(np.linalg.norm(direction), 1e-12)).tolist()
    along = F.aggregate(F.zip_with("x", F.lit(direction), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    p = d.select("a", along.alias("along"))
    a, b = F.when(F.col("a"), F.col("along")), F.when(~F.col("a"), F.col("along"))
    spread = F.greatest(F.sqrt(0.5 * (F.var_samp(a) + F.var_samp(b))), F.lit(1e-12))
    return p.agg((F.abs(F.avg(a) - F.avg(b)) / spread).alias("separability")).select(
        F.lit(width).alias("width"), F.lit(rank).alias("effective_rank"), F.lit(rank / width).alias("rank_fraction"), "separability")
