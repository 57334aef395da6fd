"""Hand-computed fixtures and invariants."""

from __future__ import annotations

import dataclasses
import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import image, vector
from lodestar.operators import mining, sampling, search, splits
from lodestar.operators.head import Head
from lodestar.plans import training
from lodestar.schema import EngineConfig


def items(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def line(spark, *points):
    """One batch of points on a line: (label, x)."""
    rows = items(spark, [(k, lab, [float(x)]) for k, (lab, x) in enumerate(points)])
    batches = rows.select(F.lit(0).cast("long").alias("batch"), F.col("vec_id").cast("int").alias("slot"), "vec_id", "label")
    return batches, mining.batch_pairs(batches, rows)


def triples(df):
    return sorted((r["a"], r["p"], r["n"]) for r in df.collect())


def test_knn_ties_and_misses(spark):
    gallery = items(spark, [(10, 0, [0.0, 1.0]), (11, 1, [1.0, 0.0]), (12, 0, [0.0, 3.0]), (13, 1, [5.0, 5.0]), (14, 2, [9.0, 9.0])])
    queries = items(spark, [(0, 1, [0.0, 0.0]), (1, 2, [8.0, 8.0]), (2, 9, [0.0, 2.0])])
    found = search.knn(queries, gallery, 5)
    got = {q: [r["g"] for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["q"] == q] for q in (0, 1, 2)}
    assert got[0] == [10, 11, 12, 13, 14]  # 10 and 11 are equally far
    assert got[2][:2] == [10, 12]
    assert sorted(map(tuple, search.knn_pairs(queries, gallery, 5).select("q", "g", "rank", "d").collect())) == sorted(
        map(tuple, found.select("q", "g", "rank", "d").collect())
    )
    row = search.recall(queries, found, (1, 3, 5)).first()
    assert list(row) == pytest.approx([1 / 3, 2 / 3, 2 / 3])  # the class of query 2 is absent: a miss


def sets(rng):
    """Vectors of many kinds: name, values."""
    unit = rng.normal(size=(60, 7))
    yield "around zero", unit
    yield "far from zero", 1e6 + 1e-3 * rng.normal(size=(60, 64))
    yield "far, in two places", np.where(np.arange(60)[:, None] % 2, 1e6, -1e6) + 1e-3 * rng.normal(size=(60, 16))
    yield "ties", np.repeat(rng.integers(0, 2, (12, 3)).astype(float), 5, axis=0)
    yield "with zero vectors", unit * (np.arange(60)[:, None] % 4 > 0)
    yield "all zero", np.zeros((60, 3))
    yield "of many sizes", unit * 10.0 ** rng.integers(-9, 9, (60, 1))
    yield "tiny and huge", unit * 10.0 ** rng.choice([-170, -150, 0, 150, 170], (60, 1))
    yield "with NaN", np.where(rng.random((60, 7)) < 0.03, np.nan, unit)


def plain_knn(v, k, metric, same=True):
    """Term by term in plain Python: (q, g, rank, d)."""
    total = lambda xs: reduce(lambda s, x: s + x, xs, 0.0)

    def distance(a, b):
        if metric == "l2":
            return math.sqrt(total((x - y) * (x - y) for x, y in zip(a, b, strict=True)))
        inner = total(x * y for x, y in zip(a, b, strict=True))
        if metric == "ip":
            return -inner
        size = math.sqrt(total(x * x for x in a)) * math.sqrt(total(x * x for x in b))
        return 1.0 - (inner / size if size else 0.0)

    out = []
    for q, a in enumerate(v):
        near = sorted(((math.isnan(d), d, g) for g, b in enumerate(v) if not same or g != q for d in [distance(a, b)]), key=lambda x: (x[0], 0 if x[0] else x[1], x[2]))
        out += [(q, g, r + 1, d) for r, (_, d, g) in enumerate(near[:k])]
    return out


def tuples(df):
    rows = [tuple(r) for r in df.select("q", "g", "rank", "d").collect()]
    return sorted((q, g, r, "nan" if d != d else d + 0.0) for q, g, r, d in rows)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_knn_equals_pairs(spark, metric):
    for name, values in sets(np.random.default_rng(1)):
        rows = items(spark, [(k, k % 3, v) for k, v in enumerate(values.tolist())]).repartition(3)
        want = sorted((q, g, r, "nan" if d != d else d + 0.0) for q, g, r, d in plain_knn(values.tolist(), 4, metric))
        assert tuples(search.knn(rows, rows, 4, metric, same=True)) == want, name
        assert tuples(search.knn_pairs(rows, rows, 4, metric, same=True)) == want, name


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pairs_under_bounds(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "GROWTH", 4)
    for name, values in sets(np.random.default_rng(3)):
        rows = items(spark, [(k, k % 3, v) for k, v in enumerate(values.tolist())]).repartition(3)
        want = sorted((q, g, r, "nan" if d != d else d + 0.0) for q, g, r, d in plain_knn(values.tolist(), 4, metric))
        assert tuples(search.knn_pairs(rows, rows, 4, metric, same=True)) == want, name


def test_few_pairs_are_put_in_order(spark, monkeypatch):
    """Half of the vectors are copies, so ties must be ruled out by id."""
    values = np.random.default_rng(4).normal(size=(2000, 4)) * (np.arange(2000)[:, None] % 2)
    rows = items(spark, [(k, 0, v) for k, v in enumerate(values.tolist())]).repartition(3)
    queries, ordered, ranked = rows.filter("vec_id % 25 = 0"), [], search._ranked
    want = tuples(search.knn(queries, rows, 3))
    monkeypatch.setattr(search, "_ranked", lambda pairs, k: ordered.append(pairs.count()) or ranked(pairs, k))
    assert tuples(search.knn_pairs(queries, rows, 3)) == want
    assert sum(ordered) < 80 * 2000 / 4


def test_true_neighbours_are_kept_far_from_zero():
    """By the bound alone, portion by portion, whatever the norms."""
    rng = np.random.default_rng(9)
    for scale, spread in ((1e2, 1.0), (1e6, 1e-3), (1e9, 1e-4), (1e12, 1.0)):
        v = scale + spread * rng.normal(size=(300, 64))
        best = search.Nearest(np.arange(300), np.zeros(300), v, 5, "l2", True)
        for k in range(0, 300, 70):
            best.add(np.arange(k, min(300, k + 70)), np.zeros(70)[: 300 - k], v[k : k + 70])
        d = np.stack([search._exact("l2", np.repeat(v[k : k + 1], 300, axis=0), v) for k in range(300)])
        np.fill_diagonal(d, np.inf)
        assert (best.g == np.lexsort((np.broadcast_to(np.arange(300), d.shape), d))[:, :5]).all()


def test_a_task_keeps_k_rows_of_many_copies():
    best = search.Nearest(np.arange(3), np.zeros(3), np.zeros((3, 2)), 4, "l2", False)
    best.add(np.arange(5000)[::-1], np.full(5000, np.nan), np.ones((5000, 2)))
    rows = best.rows()
    assert rows["g"].to_pylist() == [0, 1, 2, 3] * 3 and rows["gl"].null_count == 12


def test_registered_metrics(spark):
    vector.register_metric("l1", lambda a, b, dim: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    try:
        rng = np.random.default_rng(10)
        values = rng.normal(size=(30, 3))
        rows = items(spark, [(k, 0, v) for k, v in enumerate(values.tolist())])
        d = np.abs(values[:, None] - values).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        got = {(r["q"], r["rank"]): (r["g"], r["d"]) for r in search.knn(rows, rows, 3, "l1", same=True).collect()}
        for q in range(30):
            for rank, g in enumerate(np.argsort(d[q])[:3], 1):
                assert got[q, rank] == (g, pytest.approx(d[q, g]))
        with pytest.raises(KeyError):
            search.knn(rows, rows, 3, "unknown")
        with pytest.raises(ValueError):
            vector.register_metric("l2", None)
    finally:
        vector.METRICS.pop("l1")


def test_registered_terms_equal_the_kernel(spark, monkeypatch):
    """With a term, the search doesn't go pair by pair; its rows are those of the kernel to the bit."""
    l1 = lambda a, b, dim: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    by_pairs = search.knn_pairs
    monkeypatch.setattr(search, "SQUARE", (7, 16))
    monkeypatch.setattr(search, "knn_pairs", None)
    try:
        vector.register_metric("l1", l1, lambda x, y: np.abs(x - y))
        for name, values in sets(np.random.default_rng(5)):
            rows = items(spark, [(k, k % 3, v) for k, v in enumerate(values.tolist())]).repartition(3)
            want = tuples(by_pairs(rows, rows, 4, "l1", same=True))
            assert tuples(search.knn(rows, rows, 4, "l1", same=True)) == want, name
        monkeypatch.setattr(search, "QUERY_BYTES", 300)
        monkeypatch.setattr(search, "BLOCK_BYTES", 1500)
        assert tuples(search.knn(rows, rows, 4, "l1", same=True)) == want
        vector.register_metric("l1", l1)
        assert "l1" not in vector.TERMS
    finally:
        vector.METRICS.pop("l1", None)
        vector.TERMS.pop("l1", None)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_in_blocks_and_short_gallery(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    rows = items(spark, [(k, None if k % 7 == 0 else k % 3, rng.normal(size=4).tolist()) for k in range(40)])
    whole = sorted(map(tuple, search.knn(rows, rows, 3, metric).collect()), key=repr)
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    monkeypatch.setattr(search, "BLOCK_BYTES", 400)
    monkeypatch.setattr(search, "TILE_BYTES", 800)
    for form in (search.knn, search.knn_pairs):
        assert sorted(map(tuple, form(rows, rows, 3, metric).collect()), key=repr) == whole
    assert search.knn(rows, rows.limit(2), 9).count() == 80
    assert search.knn(rows, rows.limit(0), 9).count() == 0


def test_semi_hard_bounds_are_strict(spark):
    _, pairs = line(spark, (0, 0), (0, 1), (1, 1), (1, 2))
    assert not [t for t in triples(mining.semi_hard(pairs, 1.0)) if t[0] == 0]
    assert [t for t in triples(mining.semi_hard(pairs, 1.5)) if t[0] == 0] == [(0, 1, 3)]


def test_hard(spark):
    _, pairs = line(spark, (0, 0), (0, 3), (1, 1), (1, 2), (1, 3))
    assert [t for t in triples(mining.hard(pairs)) if t[0] == 0] == [(0, 1, 2), (0, 1, 3)]
    assert [t for t in triples(mining.hard(pairs, closest_only=True)) if t[0] == 0] == [(0, 1, 2)]


def test_lonely_class_and_disjoint_mining(spark):
    _, pairs = line(spark, (0, 0), (1, 1), (1, 3), (2, 7))
    semi, hard = triples(mining.semi_hard(pairs, 5.0)), triples(mining.hard(pairs))
    assert all(a in (1, 2) for a, _, _ in semi + hard)
    assert not set(semi) & set(hard)


def test_epoch_divisor_counts_empty_batches(spark):
    batches = spark.range(3).withColumnRenamed("id", "batch")
    stats = spark.createDataFrame([(0, 2, 0.6, 1.0, 2.0), (2, 1, 0.3, 2.0, 4.0)], "batch long, triplets long, loss double, mean_pos_dist double, mean_neg_dist double")
    row = mining.epoch_rollup(batches, stats).first()
    assert (row["loss"], row["mean_pos_dist"], row["mean_neg_dist"], row["triplets_mined"], row["batches"]) == (pytest.approx(0.3), 1.0, 2.0, 3, 3)


def test_best_flags(spark):
    log = spark.createDataFrame([("r", 0, 0.5, 0.9), ("r", 1, 0.5, 0.8), ("r", 2, 0.7, 0.85), ("r", 3, 0.6, 0.7)], "run string, epoch int, m double, l double")
    rows = mining.best_flags(log, "run", "epoch", "m", "l").orderBy("epoch").collect()
    assert [r["is_best_metric"] for r in rows] == [True, False, True, False]
    assert [r["is_best_loss"] for r in rows] == [True, True, False, True]
    assert [r["is_last"] for r in rows] == [False, False, False, True]


def test_positional_split_drops_the_rest(spark):
    rows = items(spark, [(k, k % 3, [0.0]) for k in range(11)])
    got = splits.positional(rows, 0.34).groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in got} == {"test": 3, "train": 6, "dropped": 2}


def test_split_by_group_keeps_copies_together(spark):
    rows = spark.createDataFrame([(k, k % 2, k // 4) for k in range(80)], "vec_id long, label int, src long")
    got = splits.per_class(rows, 0.3, group="src").groupBy("label", "src").agg(F.count_distinct("is_query").alias("n"))
    assert {r["n"] for r in got.collect()} == {1}


def test_split_keeps_rows_without_a_class_and_repeated_ones(spark):
    rows = items(spark, [(k, None if k % 4 == 0 else k % 2, [float(k)]) for k in range(40)] + [(1, 1, [1.0])] * 3)
    got = splits.per_class(rows, 0.5)
    assert got.columns == [*rows.columns, "is_query"] and got.count() == 43
    assert got.filter("vec_id = 1").select("is_query").distinct().count() == 1
    assert got.filter("label is null and is_query").count() == 5


def test_pk_wraps_and_needs_enough_classes(spark):
    rows = items(spark, [(k, k // 2, [0.0]) for k in range(8)])
    got = sampling.pk_batches(rows, 2, 4).collect()
    assert sorted((r["batch"], r["slot"]) for r in got) == [(b, s) for b in (0, 1) for s in range(8)]
    for b in (0, 1):
        mine = [r["vec_id"] for r in got if r["batch"] == b]
        assert len({r["label"] for r in got if r["batch"] == b}) == 2
        assert all(mine.count(x) == 2 for x in mine)
    with pytest.raises(sampling.TooFewClasses):
        sampling.pk_batches(rows, 5, 2)
    index = sampling.pk_index(rows)
    assert sorted(map(tuple, sampling.pk_batches(None, 2, 4, index=index).collect())) == sorted(map(tuple, got))


def test_batch_scan_is_consecutive(spark):
    rows = spark.range(100).select((F.col("id") * 3).alias("vec_id"))
    got = sorted((r["vec_id"], r["batch"], r["slot"]) for r in splits.batch_scan(rows, 16).collect())
    assert got == [(3 * k, k // 16, k % 16) for k in range(100)]


def test_vectors(spark):
    rows = items(spark, [(0, 0, [0.0, 0.0]), (1, 0, [3.0, 4.0])]).orderBy("vec_id")
    v = F.col("embedding")
    unit, raw = (rows.select(f(v)).collect() for f in (vector.l2_normalize, vector.l2_normalize_raw))
    assert [r[0] for r in unit] == [[0.0, 0.0], [0.6, 0.8]]
    assert np.isnan(raw[0][0]).all() and raw[1][0] == [0.6, 0.8]
    with pytest.raises(ValueError):
        vector.width(items(spark, [(0, 0, [1.0]), (1, 0, [1.0, 2.0])]), "embedding")
    vector.register_sql(spark)
    got = spark.sql("SELECT l2_distance(array(0D, 0D), array(3D, 4D)), inner_product(array(1D, 2D), array(3D, 4D)), cosine_distance(array(1D, 0D), array(0D, 2D)), l2_normalize(array(0D, 5D))").first()
    assert list(got) == [5.0, 11.0, 1.0, [0.0, 1.0]]


def test_unrolled_distance_equals_higher_order(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(rng.normal(size=64).tolist(), rng.normal(size=64).tolist()) for _ in range(50)], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert all(x == y for x, y in rows.select(vector.l2(a, b, 64), vector.l2(a, b)).collect())


def test_mask_and_flips(spark):
    rows = spark.createDataFrame([(0, y, x, float(4 * y + x)) for y in range(4) for x in range(4)], "image long, y int, x int, v double")
    mask = F.col("v").isin(5.0, 6.0, 9.0, 10.0)
    assert tuple(image.bounding_box(rows, mask).first()) == (0, 1, 1, 3, 3)
    assert image.crop(rows, image.bounding_box(rows, mask)).count() == 4
    assert sorted(map(tuple, image.hflip(image.hflip(rows, 4), 4).collect())) == sorted(map(tuple, rows.collect()))
    bg = rows.select("image", "y", "x", F.lit(-1.0).alias("bg"))
    assert image.replace_background(rows, mask, bg).filter("v = -1").count() == 4


def test_image_arrays():
    rng = np.random.default_rng(4)
    img = rng.uniform(0, 255, (12, 10, 3))
    assert np.allclose(image.resize(img, 12, 10), img)
    assert np.allclose(image.resize(np.full((9, 7, 3), 8.0), 4, 5), 8.0)
    assert image.to_tensor(img, 8).shape == (3, 8, 8)
    assert image.augment(img, np.random.default_rng(0), 8).shape == (8, 8, 3)
    assert np.array_equal(image.augment(img, np.random.default_rng(5), 8), image.augment(img, np.random.default_rng(5), 8))
    mask = np.zeros((12, 10), bool)
    mask[2:5] = True
    assert np.allclose(image.composite(img, ~mask & mask, np.zeros((3, 3)), 6), image.resize(img, 6, 6))
    assert np.allclose(image.rotate(img, 0), img)


@pytest.mark.parametrize("hidden,normalize", [(5, True), (5, False), (0, True)])
def test_gradient(hidden, normalize):
    rng = np.random.default_rng(6)
    x, labels = rng.normal(size=(8, 6)), np.array([0, 0, 1, 1, 2, 2, 3, 3])
    head = Head.random(6, hidden, 4, normalize)
    y, tape = head.forward(x)
    triplets = training.semi_hard(y, labels, 2.0)
    assert len(triplets)
    margin = 0.1  # so that some triplets are inactive
    grads = head.backward(training.triplet_loss(y, triplets, margin)[1], tape)
    for layer, grad in zip(head.layers, grads, strict=True):
        for p, g in zip(layer, grad, strict=True):
            for i in np.ndindex(p.shape):
                old, values = p[i], []
                for step in (1e-6, -1e-6):
                    p[i] = old + step
                    values.append(training.triplet_loss(head.forward(x)[0], triplets, margin)[0])
                p[i] = old
                assert g[i] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-6)


def test_mining_in_numpy_equals_the_operator(spark):
    rng = np.random.default_rng(7)
    x, labels = rng.normal(size=(12, 3)), np.arange(12) % 4
    rows = items(spark, [(k, int(labels[k]), x[k].tolist()) for k in range(12)])
    batches = rows.select(F.lit(0).cast("long").alias("batch"), F.col("vec_id").cast("int").alias("slot"), "vec_id", "label")
    found = mining.semi_hard(mining.batch_pairs(batches, rows), 0.8)
    assert triples(found) == sorted(map(tuple, training.semi_hard(x, labels, 0.8).tolist()))
    loss = mining.batch_stats(found, 0.8).first()
    want = training.triplet_loss(x, training.semi_hard(x, labels, 0.8), 0.8)
    assert (loss["loss"], loss["mean_pos_dist"], loss["mean_neg_dist"]) == pytest.approx((want[0], want[2], want[3]))


def test_training_learns_saves_and_repeats(spark, tmp_path):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 10))
    rows = items(spark, [(k, k % 6, (centers[k % 6] + 0.8 * rng.normal(size=10)).tolist()) for k in range(120)])
    rows = splits.per_class(rows, 0.3)
    train, val = rows.filter("not is_query"), rows.filter("is_query")
    config = EngineConfig(classes_per_batch=3, items_per_class=4, hidden_dim=16, output_dim=4, epochs=3, lr=1e-2, margin=0.7, recall_k=(1, 3), dropout=0.1)
    head, log = training.train_and_evaluate(train, val, config, "a", tmp_path.as_uri())
    assert log == training.train_and_evaluate(train, val, config, "a")[1]
    assert all(r["recall"][1] <= r["recall"][3] for r in log)
    again = Head.load(spark, tmp_path.as_uri(), "a", "last")
    assert all(np.allclose(a, b) for x, y in zip(head.layers, again.layers, strict=True) for a, b in zip(x, y, strict=True))
    losses = training.train(train, config)[1]
    assert len(losses) == 3 * 2 and all(x > 0 for x in losses)  # two batches an epoch
    assert training.train(train, config)[1] == losses
    assert training.train(train, dataclasses.replace(config, margin=1e-12))[1] == []  # no triplets, no steps
    said = []
    training.train_and_evaluate(train, val, dataclasses.replace(config, epochs=1), report=said.append)
    assert said == ["epoch 0: new best mean recall %.4f" % (sum(log[0]["recall"].values()) / 2)]
    arrow = {r["vec_id"]: r["embedding"] for r in head.embed(val).collect()}
    column = {r["vec_id"]: r["e"] for r in val.select("vec_id", head.column(F.col("embedding")).alias("e")).collect()}
    assert all(np.allclose(arrow[k], column[k]) for k in arrow)


def test_tuning_trains_fresh_heads(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(5, 6))
    rows = items(spark, [(k, k % 5, (centers[k % 5] + 0.5 * rng.normal(size=6)).tolist()) for k in range(100)])
    rows = splits.per_class(rows, 0.4)
    train, rest = rows.filter("not is_query").drop("is_query"), rows.filter("is_query").drop("is_query")
    val, test = rest.filter("vec_id % 2 = 0"), rest.filter("vec_id % 2 = 1")
    space = {"epochs": ("int", 1, 2), "lr": ("log", 1e-3, 1e-2), "margin": ("float", 0.5, 1.0), "output_dim": ("choice", 2, 3), "hidden_dim": ("choice", 4, 8), "P": ("choice", 2, 9), "K": ("choice", 3)}
    config = EngineConfig(recall_k=(1, 3))
    trials, log = training.tune(train, val, train, test, 3, config, space)
    found = {r["trial_id"]: r for r in trials.collect()}
    assert len(found) == 3 and {r["P"] for r in found.values()} <= {2, 9}
    for k, r in found.items():
        epochs = sorted((x for x in log.collect() if x["run"] == f"trial-{k}"), key=lambda x: x["epoch"])
        assert len(epochs) == (r["epochs"] if r["P"] == 2 else 0)
        if r["P"] == 2:
            own = dataclasses.replace(config, classes_per_batch=2, items_per_class=3, **{n: r[n] for n in ("epochs", "lr", "margin", "output_dim", "hidden_dim")})
            head, again = training.train_and_evaluate(train, val, own)
            assert r["objective"] == pytest.approx(sum(again[-1]["recall"].values()) / 2) == pytest.approx(sum(epochs[-1]["recall"].values()) / 2)
            assert r["test_recall"] == pytest.approx(training.evaluate(head, train, test, (1, 3)))
        else:
            assert r["objective"] is None and r["test_recall"] is None
    assert training.best(trials).first()["objective"] == max(r["objective"] for r in found.values() if r["objective"] is not None)


def test_search_picks_the_best(spark):
    rows = training.search(spark, lambda t: -abs(t["margin"] - 0.5), 20)
    top = training.best(rows).first()
    assert top["objective"] == max(r["objective"] for r in rows.collect())
    for r in rows.collect():
        assert 1 <= r["epochs"] <= 50 and 1e-6 <= r["lr"] <= 1e-4 and r["P"] in (4, 8, 16, 32)
    space = training.space_of({"data": {"sampler": {"P": [2, 3]}}, "training": {"margin": [0.1, 0.2], "device": "cpu"}, "n_trials": 9})
    assert (space["P"], space["margin"], space["K"]) == (("choice", 2, 3), ("float", 0.1, 0.2), ("choice", 4, 8, 16))


def test_sampled_backgrounds_and_resume(spark):
    images = spark.createDataFrame([(f"d/c{k % 2}/{k}.jpg", f"c{k % 2}") for k in range(6)], "path string, class_name string")
    backgrounds = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "photo_image_url string")
    plan = sampling.augment_plan(images, backgrounds)
    assert plan.count() == 24 and plan.filter("out_name = '3-5.jpg'").count() == 1
    done = plan.filter("class_name = 'c0'").limit(12).unionByName(plan.filter("class_name = 'c0'").limit(4))
    assert {r["class_name"] for r in sampling.unfinished(plan, done).collect()} == {"c1"}
