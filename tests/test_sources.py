from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import image
from lodestar.sources import catalogue
from lodestar.sources.collection import Collection, training


def tree(root):
    rng = np.random.default_rng(1)
    images = {}
    for name in ("b", "a"):
        (root / name).mkdir()
        for k in range(2):
            images[f"{name}/{k}.png"] = rng.integers(0, 256, (6, 5, 3))
            (root / name / f"{k}.png").write_bytes(image.png(images[f"{name}/{k}.png"]))
    (root / "stray.txt").write_text("no class")
    return images


def test_labelled_folder(spark, tmp_path):
    images = tree(tmp_path)
    rows = catalogue.labelled_files(spark, tmp_path.as_uri()).collect()
    assert sorted((r["class_name"], r["label"]) for r in rows) == [("a", 0), ("a", 0), ("b", 1), ("b", 1)]
    decoded = catalogue.labelled_images(spark, tmp_path.as_uri())
    got = image.apply(decoded, [lambda img, rng: img]).collect()
    for r in got:
        name = "/".join(r["path"].split("/")[-2:])
        assert np.allclose(np.array(r["tensor"]).reshape(6, 5, 3), images[name])
    steps = [lambda x, rng: image.augment(x, rng, 4), lambda x, rng: image.to_tensor(x, 4)]
    a, b = (sorted(map(tuple, image.apply(decoded, steps, seed=3).collect())) for _ in range(2))
    assert a == b and len(a[0][2]) == 48


def test_tables_and_parameters(spark, tmp_path):
    (tmp_path / "bg.tsv").write_text("photo_id\tphoto_image_url\n1\thttp://x/1\n")
    assert catalogue.tab_separated(spark, (tmp_path / "bg.tsv").as_uri()).first()["photo_image_url"] == "http://x/1"
    (tmp_path / "c.yaml").write_text("data:\n  sampler: {P: 5, K: 2}\ntraining: {margin: 0.7, device: cpu}\nevaluation: {recall_k: [1, 3, 10]}\n")
    config = catalogue.parameters(spark, (tmp_path / "c.yaml").as_uri())
    assert (config.classes_per_batch, config.items_per_class, config.margin, config.recall_k, config.extra) == (5, 2, 0.7, (1, 3, 10), {"device": "cpu"})


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("r1", 0, 0.5)], "run string, epoch int, loss double")
    for _ in range(2):
        catalogue.append_metrics(log, f"{tmp_path.as_uri()}/log")
    assert spark.read.parquet(f"{tmp_path.as_uri()}/log").count() == 2
    for _ in range(2):
        catalogue.save_dataset(log, "lodestar_items")
    assert spark.table("lodestar_items").count() == 1
    spark.sql("DROP TABLE lodestar_items")
    points = spark.createDataFrame([("r1", 1.0, 2.0)], "run string, x double, y double")
    catalogue.save_dataset(log, "lodestar_map", points, "run")
    assert tuple(spark.table("lodestar_map").select("loss", "x", "y").first()) == (0.5, 1.0, 2.0)
    spark.sql("DROP TABLE lodestar_map")


def test_metrics_on_the_standard_output(spark, capsys):
    catalogue.print_metrics(spark.createDataFrame([("r1", k, 0.5) for k in range(30)], "run string, epoch int, loss double"), 2)
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("|")[2].strip() for x in lines if "r1" in x] == ["28", "29"]


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {f"{n}-x{k}.png": rng.integers(0, 256, (3, 4, 3)) for n in range(2) for k in range(2)}
    rows = [(f"c{name[-5]}", name, 3, 4, [float(x) for x in img.ravel()]) for name, img in images.items()]
    tensors = spark.createDataFrame(rows, "class_name string, out_name string, height int, width int, rgb array<double>").repartition(2)
    saved = catalogue.save_images(catalogue.encode_png(tensors), f"{tmp_path.as_uri()}/out")
    assert sorted(r["path"].split("/out/")[1] for r in saved.collect()) == ["c0/0-x0.png", "c0/1-x0.png", "c1/0-x1.png", "c1/1-x1.png"]
    assert sorted(p.name for p in (tmp_path / "out").glob("*/*")) == sorted(images)
    again = catalogue.labelled_images(spark, f"{tmp_path.as_uri()}/out").collect()
    assert len(again) == 4 and all((image.decode(r["image"].asDict()) == images[r["path"].split("/")[-1]]).all() for r in again)


def test_collections(spark, tmp_path):
    images = tree(tmp_path)
    cached = catalogue.labelled_images(spark, tmp_path.as_uri(), cache=True, size=8)
    for r in cached.collect():
        want = image.resize(images["/".join(r["path"].split("/")[-2:])].astype(float), 8, 8)
        assert np.abs(image.decode(r["image"].asDict()) - want).max() <= 0.5
    whole = Collection(cached)
    tensors = {r["path"]: np.array(r["tensor"]) for r in whole.tensors().collect()}
    for r in cached.collect():
        assert np.allclose(tensors[r["path"]], image.to_tensor(image.decode(r["image"].asDict())).ravel(), atol=1e-4)
    some = whole.with_transform(lambda img, rng: img + rng.random()).subset(cached.filter("class_name = 'a'"))
    a, b = ({r["path"]: r["tensor"] for r in some.tensors(seed).collect()} for seed in (1, 2))
    assert len(a) == 2 and a != b
    assert sorted((r["label"], r["pos"], r["n"]) for r in some.index().collect()) == [(0, 0, 2), (0, 1, 2)]
    drawn = whole.with_transform(training).tensors(5).first()["tensor"]
    assert len(drawn) == 3 * 224 * 224
    cached.unpersist()


def test_path_functions(spark):
    row = spark.createDataFrame([("x/y/z.jpg",)], "p string").select(catalogue.class_of(F.col("p")), catalogue.file_name(F.col("p"))).first()
    assert tuple(row) == ("y", "z.jpg")
