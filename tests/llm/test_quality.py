import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import quality
from kbspark.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert list(y) == sorted(y) and y[0] == 0 and y[-1] == 1 and len(y) <= 4


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d, width = len(quality.STATISTICS), 1.0
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, 20_000)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), np.array([0, 1.0]), np.array([0, 1.0]))
    x = rng.normal(size=(2, d))
    f = model.features(x)[:, :-1]
    want = np.exp(-((x[0] - x[1]) ** 2).sum() / (2 * width**2 * d))
    assert abs(f[0] @ f[1] - want) < 0.05 and abs(f[0] @ f[0] - 1) < 0.05


def test_statistics():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)
    s = dict(zip(quality.STATISTICS, quality.statistics("THE end!! | 12\nTHE end!! | 12")))
    assert s["dup_lines"] == 0.5 and s["no_letter_words"] == 0.5 and s["upper_words"] == 0.25 and s["distinct_words"] == 0.5
    assert np.isfinite(quality.statistics("\ud800 x")).all()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and ((rows.score >= 0.3) == (rows.quality == 1)).mean() > 0.95


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.fold_of("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


def test_bound_on_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_documents(docs, labels, max_rows=150).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()


def test_odd_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good_documents(odd, labels).columns == odd.columns
    assert len(quality.score_documents(odd, labels.limit(0)).collect()) == 10
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_fit_equals_a_plain_numpy_fit(spark):
    """Normal equations summed over partitions, the ridge term and the calibration, against one process on all rows."""
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    stats = rng.normal(size=(400, d)) * rng.uniform(0.5, 4, d)
    label = (stats[:, 0] + rng.normal(size=400) > 0).astype(int)
    fold = np.arange(400) % 4 + 1
    rows = spark.createDataFrame([(x.tolist(), int(y), int(f)) for x, y, f in zip(stats, label, fold)], "stats array<double>, label int, fold int")
    m = quality.fit(rows, n_features=64, ridge=1e-3, bins=50, tasks=3)
    assert np.allclose(m.mean, stats.mean(axis=0)) and np.allclose(m.sd, stats.std(axis=0))
    z = np.sqrt(2 / 64) * np.cos(np.clip((stats - stats.mean(axis=0)) / stats.std(axis=0), -8, 8) @ m.directions + m.phases)
    z = np.hstack([z, np.ones((400, 1))])
    own = fold != 4
    weights = np.linalg.solve(z[own].T @ z[own] + 1e-3 * own.sum() / 65 * np.eye(65), z[own].T @ label[own])
    assert np.allclose(m.weights, weights, atol=1e-6)
    raw, y = (z @ weights)[~own], label[~own]
    at = np.clip(((raw + 0.5) / 2 * 50).astype(int), 0, 49)
    points = sorted((raw[at == b].mean(), y[at == b].mean(), (at == b).sum()) for b in set(at))
    # The isotonic fit by its formula: the largest over starts of the least mean over ends.
    x, v, w = map(np.array, zip(*points))
    mean = lambda i, j: (v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
    steps = m.steps_y[[np.flatnonzero(np.isclose(m.steps_y, u))[0] for u in want]]
    assert np.allclose(steps, want) and len(m.steps_y) == len({round(u, 9) for u in want})
