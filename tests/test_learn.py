"""Models against plain numpy: the optimum itself is compared, not the way to it."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wiresift.operators import learn as le


def table(spark, n=300, width=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)) * [1, 5, 0.2, *[1] * (width - 3)][:width] + 3
    y = (x[:, 0] + 0.1 * x[:, 1] + r.normal(size=n) > 4.2).astype(float)
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(width)]).assign(y=y, k=range(n))
    return x, y, spark.createDataFrame(pdf)


def standard(x):
    return (x - x.mean(0)) / x.std(0, ddof=1)


def newton(z, y, weight, reg):
    a = np.column_stack([z, np.ones(len(z))])
    b = np.zeros(a.shape[1])
    ridge = np.diag([reg] * z.shape[1] + [0])
    w = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - y)) + ridge @ b)
    return b


def test_binary_fit_is_the_weighted_optimum(spark):
    x, y, df = table(spark)
    model = le.fit_binary(le.assemble(df, ["f0", "f1", "f2"]))
    counts = {c: (y == c).sum() for c in (0, 1)}
    want = newton(standard(x), y, np.array([len(y) / counts[c] for c in y]), 1e-4)
    lr = model.stages[-1]
    assert np.allclose([*lr.coefficients, lr.intercept], want, atol=1e-3)


def test_logistic_baseline_counts(spark):
    _, y, df = table(spark, 600)
    rows = df.select(*[F.col(f"f{i}") for i in range(3)], F.when(F.col("y") == 1, "Flood").otherwise("Benign").alias("label"), (F.col("k") % 3).cast("int").alias("split"), "k")
    got = {r.point: r for r in le.logistic_baseline(rows, ["f0", "f1", "f2"], "Flood", budgets=(0.1, 0.01)).collect()}
    d = le.assemble(rows, ["f0", "f1", "f2"]).withColumn("y", (F.col("label") == "Flood").cast("double"))
    s = le.binary_score(le.fit_binary(d.where("split = 0")), d).select("split", "score", "y").toPandas()
    calm, test = s[(s.split == 1) & (s.y == 0)].score, s[s.split == 2]
    for budget in (0.1, 0.01):
        cut = np.quantile(calm, 1 - budget, method="higher")
        r = got[f"budget {budget}"]
        alert = test.score >= cut
        assert (r.tp, r.fp, r.fn) == ((alert & (test.y == 1)).sum(), (alert & (test.y == 0)).sum(), (~alert & (test.y == 1)).sum())
        assert abs(r.threshold - cut) < 1e-12
    assert "best f1" in got


def test_family_head_is_the_multinomial_optimum(spark):
    r = np.random.default_rng(1)
    n, names = 400, ["Benign", "Flood", "Bot"]
    c = r.integers(0, 3, n)
    x = r.normal(size=(n, 2)) + np.eye(3, 2)[c] * 1.5
    df = spark.createDataFrame(pd.DataFrame({"f0": x[:, 0], "f1": x[:, 1], "label": np.array(names)[c], "split": 0, "position": range(n)}))
    scores = le.family_head(le.assemble(df, ["f0", "f1"]), names[1:]).toPandas()
    p = scores.pivot(index="position", columns="family", values="score").loc[range(n)]
    fit = ~scores.drop_duplicates("position").set_index("position").loc[range(n)].calib.to_numpy(bool)
    p = np.column_stack([1 - p["Flood"] - p["Bot"], p["Flood"], p["Bot"]])[fit]
    # at the optimum the weighted residuals are orthogonal to the constant, and to the features up to the ridge term
    size = np.bincount(c[fit])
    w = np.sqrt(fit.sum() / size)[c[fit]]
    z = standard(x[fit])
    gap = (w[:, None] / w.sum() * (p - np.eye(3)[c[fit]]))
    logit = np.log(p) - np.log(p).mean(1, keepdims=True)
    beta = np.linalg.lstsq(np.column_stack([z, np.ones(len(z))]), logit, rcond=None)[0][:2]
    assert np.abs(gap.sum(0)).max() < 1e-3 and np.abs(z.T @ gap + 1e-3 * beta).max() < 1e-3


def test_compressor_errors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": list(x)}))
    got = le.linear_compressor(le.assemble(df, array="x"), F.col("id") < 150, 3).orderBy("id").toPandas()
    fit = x[:150]
    z = (x - fit.mean(0)) / fit.std(0, ddof=1)
    axes = np.linalg.svd(z[:150])[2][:3]
    assert np.allclose(got.recon_error, ((z - z @ axes.T @ axes) ** 2).sum(1), atol=1e-6)
    assert all(len(v) == 3 for v in got.z)


def test_gate_and_attribution(spark):
    x, y, df = table(spark)
    g = le.gate_combine(df.withColumn("positive", F.col("y") == 1), "f0", "f2", "positive", F.col("k") < 200).orderBy("k").toPandas()
    fit = slice(0, 200)
    two = x[:, [0, 2]]
    z = (two - two[fit].mean(0)) / two[fit].std(0, ddof=1)
    counts = {c: (y[fit] == c).sum() for c in (0, 1)}
    b = newton(z[fit], y[fit], np.array([200 / counts[c] for c in y[fit]]), 0.0)
    assert np.allclose(g.combined, 1 / (1 + np.exp(-(z @ b[:2] + b[2]))), atol=1e-3)
    a = le.assemble(df, ["f0", "f1", "f2"])
    model = le.fit_binary(a)
    got = le.linear_attribution(model, a, 2, "k").orderBy("k").toPandas()
    part = standard(x) * np.array(model.stages[-1].coefficients)
    assert np.allclose(got.from_flow, part[:, :2].sum(1)) and np.allclose(got.from_context, part[:, 2])
    assert np.allclose(got.context_share, np.abs(part[:, 2]) / (np.abs(part[:, 2]) + np.abs(part[:, :2].sum(1)) + 1e-12))


def pooled(p, y):
    """Isotonic means of `y` in order of `p`, by pooling neighbours that fall."""
    blocks = []
    for v in y[np.argsort(p, kind="stable")]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    return np.repeat([b[0] for b in blocks], [b[1] for b in blocks])


def test_platt_and_isotonic_errors(spark):
    r = np.random.default_rng(3)
    p = r.uniform(0.02, 0.98, 400)
    y = (r.uniform(size=400) < p ** 2).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"t": range(400), "p": p, "truth": y == 1}))
    got = {row["method"]: row for row in le.platt_and_isotonic(df, first_half=F.col("t") < 200).collect()}
    z = np.log(p / (1 - p))
    b = newton(z[:200, None], y[:200], np.ones(200), 0.0)
    iso = np.interp(p[200:], np.sort(p[:200]), pooled(p[:200], y[:200]))
    for name, q in (("raw", p[200:]), ("platt", 1 / (1 + np.exp(-(z[200:] * b[0] + b[1])))), ("isotonic", iso)):
        assert abs(got[name]["brier"] - ((q - y[200:]) ** 2).mean()) < 1e-4, name


def test_probe_counts(spark):
    _, y, df = table(spark, 500)
    d = le.assemble(df.withColumnsRenamed({"k": "vec_id", "y": "target"}), ["f0", "f1", "f2"])
    got = le.probe(d, "target", F.col("vec_id") % 3 > 0).first()
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    d = d.withColumn("y", F.col("target"))
    s = le.binary_score(le.fit_binary(d.where((F.col("vec_id") % 3 > 0) & ~held)), d.withColumn("held", held)).toPandas()
    tune, s = s[(s.vec_id % 3 > 0) & s.held], s[s.vec_id % 3 == 0]

    def counts(x, cut):
        alert = x.score >= cut
        return (alert & (x.y == 1)).sum(), (alert & (x.y == 0)).sum(), (~alert & (x.y == 1)).sum()
    f1 = {cut: 2 * tp / (2 * tp + fp + fn) for cut in tune.score for tp, fp, fn in [counts(tune, cut)]}
    best = [cut for cut, f in f1.items() if f > max(f1.values()) - 1e-12]
    assert (got.tp, got.fp, got.fn) in [counts(s, cut) for cut in best]
    pos, neg = s[s.y == 1].score.to_numpy(), s[s.y == 0].score.to_numpy()
    assert abs(got.auroc - ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()) < 1e-9


@pytest.mark.parametrize("n, width", [(400, 7), (60, 2000), (5, 8)])
def test_representation_quality_at_any_width(spark, n, width):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, width)) * np.linspace(0.1, 3, width) + 5
    attack = np.arange(n) % 3 == 0
    x[attack] += 0.5
    got = le.representation_quality(spark.createDataFrame([(row, bool(a)) for row, a in zip(x.tolist(), attack)], "x array<double>, a boolean").repartition(9), "x", "a").first()
    sv = np.linalg.svd(x - x.mean(0), compute_uv=False)
    share = np.clip(sv / sv.sum(), 1e-12, None)
    rank = np.exp(-(share * np.log(share)).sum())
    v = x[attack].mean(0) - x[~attack].mean(0)
    p = x @ (v / np.linalg.norm(v))
    apart = abs(p[attack].mean() - p[~attack].mean()) / np.sqrt(0.5 * (p[attack].var(ddof=1) + p[~attack].var(ddof=1)))
    assert got.width == width and np.allclose([got.effective_rank, got.rank_fraction, got.separability], [rank, rank / width, apart], rtol=1e-6)


def test_representation_quality_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "x array<double>, a boolean")
    none = le.representation_quality(make([(None, True)]), "x", "a").first()
    assert (none.width, none.effective_rank, none.separability) == (0, None, None)
    one = le.representation_quality(make([([1.0, 2.0], True), ([2.0, 0.0], True), (None, False)]), "x", "a").first()
    assert one.width == 2 and one.separability is None
    with pytest.raises(ValueError):
        le.representation_quality(make([([1.0], True), ([1.0, 2.0], False)]), "x", "a")
