"""Training by epochs: the gradient, the whole run against one in plain numpy, and runs that are taken up."""

import shutil

import numpy as np
import pytest
from loomline.operators import epochs, metrics


def data(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    return rng.normal(size=(n, 4)) + np.eye(3, 4)[y] * 1.5, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id int, embedding array<double>, label int")


def test_gradient():
    rng = np.random.default_rng(0)
    (x, y), w, weight = data(50, 1), rng.normal(size=(3, 5)), rng.random(50)
    g, _ = epochs.gradient(w, x, y, weight)
    for i in np.ndindex(w.shape):
        d = np.zeros_like(w)
        d[i] = 1e-6
        assert abs((epochs.gradient(w + d, x, y, weight)[1] - epochs.gradient(w - d, x, y, weight)[1]) / 2e-6 - g[i]) < 1e-7


def plain(x, y, plan):
    """The same steps over all rows at once, one batch an epoch."""
    n = np.bincount(y, minlength=plan.classes)
    weight = (len(y) / ((n > 0).sum() * n))[y]
    w = first = second = np.zeros((plan.classes, plan.dim + 1))
    for step in range(plan.epochs):
        g, _ = epochs.gradient(w, x, y, weight / weight.sum())
        w, first, second = epochs.adam(w, g, first, second, step, plan.rate_at(step), plan.decay)
    return w


def test_a_run_and_one_taken_up(spark, tmp_path):
    (x, y), (u, v) = data(400, 2), data(200, 3)
    odd = spark.createDataFrame([(-1, None, 1), (-2, [1.0] * 4, None), (-3, [1.0] * 4, 7), (-4, [1.0], 1), (-5, [float("nan")] * 4, 1)], "id int, embedding array<double>, label int")
    rows, held = frame(spark, x, y).union(odd), frame(spark, u, v)
    plan = epochs.Plan(classes=3, dim=4, epochs=6, rate=0.2, decay=0.01)
    whole = epochs.train(rows, held, f"{tmp_path}/a", plan).orderBy("epoch").collect()
    last = epochs._weights(plan, epochs._state(spark, f"{tmp_path}/a", 5).weights)
    np.testing.assert_allclose(last, plain(x, y, plan), atol=1e-5)  # its means divide by roots of what starts at 0
    assert [r.epoch for r in whole] == list(range(6)) and whole[-1].loss < whole[0].loss and sum(r.best for r in whole) == 1

    assert epochs.train(rows, held, f"{tmp_path}/c", plan, until=2).count() == 2
    for part in ("plan", "rows", "epoch=0", "epoch=1"):
        shutil.copytree(tmp_path / "a" / part, tmp_path / "b" / part)
    (tmp_path / "b" / "epoch=1" / "_SUCCESS").unlink()  # as a run leaves it that died while writing
    again = epochs.train(rows.repartition(7), held, f"{tmp_path}/b", plan).orderBy("epoch").collect()
    assert again == whole
    assert epochs._state(spark, f"{tmp_path}/b", 5).weights == last.tobytes()
    with pytest.raises(ValueError, match="another plan"):
        epochs.train(rows, held, f"{tmp_path}/b", epochs.Plan(classes=3, dim=4, epochs=7))

    best = epochs.best(spark, f"{tmp_path}/a")
    assert best.epoch == max(whole, key=lambda r: (r.macro_f1, -r.epoch)).epoch
    said = best.predict(held.union(odd.where("id = -1"))).collect()
    p = epochs.softmax(np.c_[u, np.ones(len(u))] @ best.weights.T)
    own = {r.id: r for r in said}
    assert own[-1].prediction is None and own[-1].probability is None
    assert all(own[i].prediction == p[i].argmax() and np.allclose(own[i].probability, p[i]) for i in range(len(u)))
    f1 = metrics.macro_f1(best.predict(held).selectExpr("label AS y", "prediction AS p")).first()[0]
    assert f1 == whole[best.epoch].macro_f1 > 0.5


def test_early_stop_and_batches(spark, tmp_path):
    (x, y), (u, v) = data(120, 4), data(60, 5)
    plan = epochs.Plan(classes=3, dim=4, epochs=30, batches=3, rate=0.5, patience=2)
    got = epochs.train(frame(spark, x, y), frame(spark, u, v), f"{tmp_path}/c", plan).orderBy("epoch").collect()
    best = next(r.epoch for r in got if r.best)
    assert len(got) < 30 and len(got) - 1 - best == 2
    assert epochs.train(frame(spark, x, y), frame(spark, u, v), f"{tmp_path}/c", plan).count() == len(got)
    assert [plan.rate_at(s) for s in (0, 8, 9, 89)] == pytest.approx([0.5 / 9, 0.5, 0.5, 0.5 / 81])
