import random

import numpy as np

from tallyloom.llm import ordinal


def _texts(n, seed):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    insults = ["vile", "scum", "foulest", "foulish", "foulness"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = r.random() < 0.25
        for _ in range(r.choice([1, 1, 2, 5]) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(insults) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_severity(spark):
    rows, labels = _texts(900, 1)
    rows += [(5000, None), (5001, ""), (None, "vile scum"), rows[3]]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, severity double")
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = ordinal.train(docs, known)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in ordinal.severity(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if i % 3 == 0]
    right = sum(got[i].toxic == bool(truth[i]) for i in held)
    assert right / len(held) > 0.98
    assert not got[5000].toxic and not got[5001].toxic and got[None].toxic
    for r in got.values():
        assert 1 >= r.above[0] >= r.above[1] >= 0 and abs(r.severity - sum(r.above)) < 1e-12
    assert np.mean([got[i].severity for i in held if truth[i]]) > 1 > 0.1 > np.mean([got[i].severity for i in held if not truth[i]])


def test_gradient_lowers_the_loss():
    r = np.random.default_rng(0)
    grades = r.integers(0, 3, 200)
    rows = [np.array([g, 3 + int(r.integers(0, 4))]) for g in grades]
    weights, cuts = ordinal.fit(rows, grades, 7)
    assert weights[0] < weights[1] < weights[2] and cuts[0] < cuts[1]
    z = np.array([weights[x].sum() for x in rows])
    assert ((z[:, None] > cuts[None, :]).sum(axis=1) == grades).mean() > 0.95


def plain_loss(weights, cuts, rows, grades, penalty):
    total = 0.0
    for row, grade in zip(rows, grades):
        z = sum(weights[f] for f in row)
        over = [1.0, *(1 / (1 + np.exp(c - z)) for c in cuts), 0.0]
        total -= np.log(over[grade] - over[grade + 1])
    return total / len(rows) + penalty / 2 * sum(w * w for w in weights)


def test_loss_and_gradient_equal_the_plain_form_and_its_differences():
    r = np.random.default_rng(3)
    for levels in (1, 2, 3):
        rows = [r.choice(6, size=int(r.integers(0, 5)), replace=False) for _ in range(40)]
        grades = r.integers(0, levels + 1, 40)
        theta = r.normal(0, 0.7, 6 + levels)

        def value(t):
            cuts = t[6] + np.concatenate(([0.0], np.cumsum(np.exp(t[7:]))))
            return plain_loss(t[:6], cuts, rows, grades, 0.01)

        got, gradient = ordinal.loss(theta, ordinal.Sample.of(rows), grades, 6, 0.01)
        assert abs(got - value(theta)) < 1e-12
        for i in range(len(theta)):
            step = np.eye(len(theta))[i] * 1e-6
            assert abs((value(theta + step) - value(theta - step)) / 2e-6 - gradient[i]) < 1e-6


def test_cut_is_the_one_that_is_right_most_often():
    r = np.random.default_rng(4)
    for _ in range(50):
        toxic = r.random(30) < 0.4
        chance = np.round(np.clip(toxic * 0.3 + r.random(30) * 0.7, 0, 1), 1)
        cut = ordinal.best_cut(chance, toxic)
        assert ((chance >= cut) == toxic).sum() == max(((chance >= c) == toxic).sum() for c in [0.5, *np.unique(chance)[1:]])


def test_severity_ranks_held_out_rows_by_their_insults(spark):
    rows, labels = _texts(1500, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ordinal.train(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    count = {i: sum(t.count(w) for w in ("vile", "scum", "foul")) for i, t in rows}
    got = {r.doc_id: r.severity for r in ordinal.severity(docs, model).collect() if r.doc_id % 3 == 0}
    by = {n: np.mean([s for i, s in got.items() if count[i] == n]) for n in (0, 1, 2, 5)}
    assert by[0] < 0.1 < by[1] < by[2] < by[5]


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        model = ordinal.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [(r.severity, r.toxic) for r in ordinal.severity(docs, model).collect()] == [(0.0, False)] * 2
    assert ordinal.severity(docs.limit(0), model).count() == 0
