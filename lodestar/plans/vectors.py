"""Queries over vectors and tiles: normalisation, pooling, the head's forward pass, images, logs, plans, trials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import image, vector
from lodestar.functions.hashing import draw_sql
from lodestar.operators import mining, sampling
from lodestar.operators.head import Head
from lodestar.operators.search import knn
from lodestar.plans import training
from lodestar.plans.map2d import fuzzy_graph as fuzzy_edges
from lodestar.plans.map2d import map_2d
from lodestar.plans.map2d import neighbour_map as manifold
from lodestar.plans.retrieval import ORACLE_SQL as RETRIEVAL
from lodestar.plans.retrieval import items
from lodestar.schema import EngineConfig
from lodestar.sources.catalogue import class_of

SIDE, TOKENS, THRESHOLD, LR, DECAY, FACTORS = 8, 8, 0.2, 1e-2, 1e-1, (1.25, 0.75, 1.3)


def _v() -> Column:
    return F.col("embedding")


def _long(rows: DataFrame, v) -> DataFrame:
    """(vec_id, pos, x) of an array expression."""
    return rows.select("vec_id", F.posexplode(v).alias("pos", "x")).withColumn("x", F.round("x", 6))


def l2_normalize(spark, sf_dir):
    return _long(items(spark, sf_dir), vector.l2_normalize(F.transform(_v(), lambda x: x * 3.0)))


def l2_normalize_raw(spark, sf_dir):
    return _long(items(spark, sf_dir), vector.l2_normalize_raw(F.transform(_v(), lambda x: x * 3.0)))


def conditional_normalize(spark, sf_dir):
    return _long(items(spark, sf_dir), vector.conditional_normalize(F.transform(_v(), lambda x: x * 3.0), F.col("label") % 2 == 0))


def token_mean_pool(spark, sf_dir):
    return _long(items(spark, sf_dir), vector.mean_pool(vector.tokens(_v(), TOKENS, SIDE), SIDE))


def pooled_or_mean(spark, sf_dir):
    """Even labels have a pooler's output, their first token."""
    pooler = F.when(F.col("label") % 2 == 0, F.slice(_v(), 1, SIDE))
    return _long(items(spark, sf_dir), vector.pooled(pooler, vector.tokens(_v(), TOKENS, SIDE), SIDE))


def sample_head(dim: int = 64, hidden: int = 8, out: int = 4) -> Head:
    """Small weights from md5 draws."""
    import hashlib

    def weight(*parts) -> float:
        return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:7], 16) % 2001 - 1000) / 1000

    sizes = [(hidden, dim), (out, hidden)]
    layers = [(np.array([[weight("w", k, i, j) for j in range(n)] for i in range(m)]), np.array([weight("b", k, i) for i in range(m)])) for k, (m, n) in enumerate(sizes)]
    return Head(layers, normalize=False)


def head_forward(spark, sf_dir):
    return _long(items(spark, sf_dir), sample_head().column(_v()))


def embed(spark, sf_dir):
    """The whole embedding in Arrow batches: head and unit length."""
    head = sample_head()
    head.normalize = True
    return _long(head.embed(items(spark, sf_dir)), _v())


def tiles(spark, sf_dir) -> DataFrame:
    return image.pixels(items(spark, sf_dir), SIDE, "vec_id", "embedding")


def _mask() -> Column:
    return F.col("v") > F.lit(THRESHOLD)


def pixel_normalize(spark, sf_dir):
    return tiles(spark, sf_dir).withColumn("v", F.round(image.scale_normalize(F.col("v"), 0.485, 0.229, 1.0), 6))


def hflip(spark, sf_dir):
    return image.hflip(tiles(spark, sf_dir), SIDE).withColumn("v", F.round("v", 6))


def vflip(spark, sf_dir):
    return image.vflip(tiles(spark, sf_dir), SIDE).withColumn("v", F.round("v", 6))


def mask_apply(spark, sf_dir):
    return tiles(spark, sf_dir).withColumn("v", F.round(image.mask_apply(F.col("v"), _mask()), 6))


def mask_bbox(spark, sf_dir):
    return image.bounding_box(tiles(spark, sf_dir), _mask())


def mask_crop(spark, sf_dir):
    rows = tiles(spark, sf_dir)
    return image.crop(rows, image.bounding_box(rows, _mask())).withColumn("v", F.round("v", 6))


def background_replace(spark, sf_dir):
    """The background of an image is the flipped image."""
    rows = tiles(spark, sf_dir)
    return image.replace_background(rows, _mask(), image.hflip(rows, SIDE).withColumnRenamed("v", "bg")).withColumn("v", F.round("v", 6))


def resize_nearest(spark, sf_dir):
    return image.resize_nearest(tiles(spark, sf_dir), SIDE, 4).withColumn("v", F.round("v", 6))


def _on_tiles(spark, sf_dir, step, channels: int) -> DataFrame:
    """(image, c, y, x, v) of ``step`` on every tile as an RGB array, its values brought to 0..255; c first in the result's arrays."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                img = (b["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, SIDE, SIDE) + 1) * 127.5
                out = np.stack([step(np.repeat(x[..., None], 3, axis=2))[:channels] for x in img])
                at = np.indices(out.shape).reshape(4, -1)
                columns = [pa.array(b["vec_id"].to_numpy()[at[0]]), *(pa.array(at[k].astype(np.int32)) for k in (1, 2, 3)), pa.array(np.round(out.ravel(), 6))]
                yield pa.RecordBatch.from_arrays(columns, names=["image", "c", "y", "x", "v"])

    return items(spark, sf_dir).select("vec_id", "embedding").mapInArrow(run, "image long, c int, y int, x int, v double")


def eval_transform(spark, sf_dir):
    """Tiles resized to half their side, scaled and normalised by channel."""
    return _on_tiles(spark, sf_dir, lambda img: image.to_tensor(img, SIDE // 2), 3)


def resize_up(spark, sf_dir):
    """Tiles resized to one and a half times their side, without normalising."""
    return _on_tiles(spark, sf_dir, lambda img: image.resize(img, 3 * SIDE // 2, 3 * SIDE // 2).transpose(2, 0, 1), 1)


def jitter_tile(spark, sf_dir):
    """Colours of a tile whose channels are its values, half of them and a third: saturation, brightness, contrast."""
    third = 1 / np.arange(1, 4)
    return _on_tiles(spark, sf_dir, lambda img: image.jitter(img * third, FACTORS, (2, 0, 1)).transpose(2, 0, 1), 3)


def rotate_tile(spark, sf_dir):
    return _on_tiles(spark, sf_dir, lambda img: image.rotate(img, float(image.DEGREES)).transpose(2, 0, 1), 1)


def adamw_steps(spark, sf_dir):
    """Class centroids as weights, after steps by the mean vectors of even and of odd items as gradients."""
    rows = items(spark, sf_dir).select("label", (F.col("vec_id") % 2).alias("odd"), F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg("x").alias("w"), *(F.avg(F.when(F.col("odd") == k, F.col("x"))).alias(f"g{k}") for k in (0, 1)))
    found = means.fillna(0.0).orderBy("label", "pos").collect()  # the head's weights: a row a class and place
    dim = 1 + max(r["pos"] for r in found)
    matrix = lambda name: np.array([r[name] for r in found]).reshape(-1, dim)
    head = Head([(matrix("w"), np.zeros(len(found) // dim))])
    for g in ("g0", "g1"):
        head.step([(matrix(g), np.zeros(len(found) // dim))], LR, DECAY)
    out = [(r["label"], r["pos"], round(float(v), 9)) for r, v in zip(found, head.layers[0][0].ravel(), strict=True)]
    return spark.createDataFrame(out, "label int, pos int, value double")


def gray_to_rgb(spark, sf_dir):
    return image.gray_to_rgb(tiles(spark, sf_dir)).withColumn("v", F.round("v", 6))


def _log(spark, sf_dir) -> DataFrame:
    """``events`` as an epoch log: a run for each user, an epoch for each event in order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    epoch = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select(F.col("user_id").alias("run"), epoch.alias("epoch"), F.col("value").alias("metric"), F.col("value").alias("loss"))


def best_checkpoint_flags(spark, sf_dir):
    flags = mining.best_flags(_log(spark, sf_dir), "run", "epoch", "metric", "loss")
    return flags.select("run", "epoch", "is_best_metric", "is_best_loss", "is_last")


def best_checkpoint_final(spark, sf_dir):
    return mining.best_final(mining.best_flags(_log(spark, sf_dir), "run", "epoch", "metric", "loss"), "run", "epoch")


def path_label(spark, sf_dir):
    """The class of a page is its address's last folder; classes are numbered by name."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", class_of(F.col("url")).alias("class_name"))
    classes = rows.select("class_name").distinct().withColumn("label", F.row_number().over(W.orderBy("class_name")) - 1)
    return rows.join(classes, "class_name").select("page_id", "class_name", "label")


def _plan(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    images = pages.select(F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), class_of(F.col("url")).alias("class_name"))
    return sampling.augment_plan(images, pages.select(F.col("url").alias("photo_image_url")).distinct())


def augment_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


def augment_resume(spark, sf_dir):
    """Outputs of the pages numbered below 8 are there; classes with 16 files are left out."""
    plan = _plan(spark, sf_dir)
    done = plan.filter(F.regexp_extract("path", r"(\d+)", 1).cast("long") < 8)
    return sampling.unfinished(plan, done).select("path", "class_name", "n", "out_name")


N_TRIALS = 50


def trial_space(spark, sf_dir):
    return training.trials(spark, N_TRIALS).withColumns({c: F.round(c, 9) for c in ("lr", "weight_decay", "margin", "dropout")})


def best_trial(spark, sf_dir):
    """The objective is a stand-in: margin less dropout."""
    rows = training.trials(spark, N_TRIALS).withColumn("objective", F.round(F.col("margin") - F.col("dropout"), 9))
    return training.best(rows).select("trial_id", "epochs", "output_dim", "hidden_dim", "P", "K", "objective")


def train_head_log(spark, sf_dir):
    """Two epochs on the gallery side of the split, evaluated on the query side."""
    from lodestar.plans.retrieval import split

    queries, gallery = split(spark, sf_dir)
    config = EngineConfig(classes_per_batch=4, items_per_class=4, hidden_dim=16, output_dim=8, epochs=2, lr=1e-3, margin=0.7, recall_k=(1, 3))
    _, log = training.train_and_evaluate(gallery, queries, config)
    return training.log_frame(spark, log).select("run", "epoch", "loss", "mean_pos_dist", "mean_neg_dist", "triplets_mined", F.element_at("recall", 1).alias("recall_1"), F.element_at("recall", 3).alias("recall_3"))


def pca_2d(spark, sf_dir):
    return map_2d(items(spark, sf_dir))


def neighbour_map(spark, sf_dir):
    """A layout of the graph of 15 neighbours, ten epochs."""
    return manifold(items(spark, sf_dir), epochs=10)


def fuzzy_graph(spark, sf_dir):
    """The graph that the layout works on: memberships of 15 neighbours by cosine, both directions joined."""
    rows = items(spark, sf_dir)
    found = fuzzy_edges(knn(rows, rows, 15, "cosine", same=True).select("q", "g", "d"), 15)
    return found.withColumn("weight", F.round("weight", 6))


def class_centroids(spark, sf_dir):
    from lodestar.operators.head import centroids

    return centroids(items(spark, sf_dir)).withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize, l2_normalize_raw, conditional_normalize, token_mean_pool, pooled_or_mean, head_forward, embed, pixel_normalize,
        hflip, vflip, mask_apply, mask_bbox, mask_crop, background_replace, resize_nearest, eval_transform, resize_up, jitter_tile, rotate_tile, adamw_steps, gray_to_rgb, best_checkpoint_flags,
        best_checkpoint_final, path_label, augment_plan, augment_resume, trial_space, best_trial, train_head_log, pca_2d, neighbour_map, fuzzy_graph, class_centroids,
    )
}

# -- the same rows in SQL --------------------------------------------------------------------------------

_L = "l AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"
_T = "t AS (SELECT vec_id AS image, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, v FROM l)"
_TILES = f"WITH {_L}, {_T}"
_NORM = f"WITH {_L}, n AS (SELECT vec_id, sqrt(sum(v * v * 9)) AS n FROM l GROUP BY vec_id)"
_BOX = f"b AS (SELECT image, min(y) AS ymin, min(x) AS xmin, max(y) + 1 AS ymax, max(x) + 1 AS xmax FROM t WHERE v > {THRESHOLD}::DOUBLE GROUP BY image)"
_HEAD = f"""WITH {_L},
h AS (SELECT vec_id, i, greatest(sum(v * w) + any_value(b), 0) AS h FROM (
  SELECT vec_id, i, v, ({draw_sql("'w:0:' || i || ':' || pos")} % 2001 - 1000) / 1000 AS w, ({draw_sql("'b:0:' || i")} % 2001 - 1000) / 1000 AS b FROM l, range(0, 8) r(i)) GROUP BY vec_id, i),
o AS (SELECT vec_id, j, sum(h * w) + any_value(b) AS x FROM (
  SELECT vec_id, j, h, ({draw_sql("'w:1:' || j || ':' || i")} % 2001 - 1000) / 1000 AS w, ({draw_sql("'b:1:' || j")} % 2001 - 1000) / 1000 AS b FROM h, range(0, 4) r(j)) GROUP BY vec_id, j)"""
_LOG = """WITH g AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch, value FROM events),
f AS (SELECT run, epoch, value > greatest(coalesce(max(value) OVER w, 0), 0) AS is_best_metric, value < coalesce(min(value) OVER w, 'infinity'::DOUBLE) AS is_best_loss,
  epoch = max(epoch) OVER (PARTITION BY run) AS is_last FROM g WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_PLAN = f"""WITH p AS (SELECT 'img/' || page_id || '.jpg' AS path, string_split(url, '/')[-2] AS class_name FROM pages),
b AS (SELECT url AS photo_image_url, row_number() OVER (ORDER BY url) - 1 AS bg FROM (SELECT DISTINCT url FROM pages)),
a AS (SELECT path, class_name, CAST(n AS INT) AS n, n || '-' || string_split(path, '/')[-1] AS out_name, bg, photo_image_url
  FROM p JOIN range(0, 4) r(n) ON true JOIN b ON bg = {draw_sql("'bg:42:' || path || ':' || n")} % (SELECT count(*) FROM b))"""


#: Rates by bisection, a round of it for each step of the recursion.
_FUZZY = f"""WITH RECURSIVE {RETRIEVAL["cosine_knn_graph_15"].removeprefix("WITH ").rsplit("SELECT", 1)[0]},
m AS (SELECT q, g, d, greatest(0, d - coalesce(min(d) FILTER (d > 0) OVER (PARTITION BY q), 0)) AS beyond FROM nn),
f AS (SELECT q, list(beyond ORDER BY beyond) AS far, avg(d) AS mean FROM m GROUP BY q),
s(q, n, low, high, rate) AS (
  SELECT q, 0, 0::DOUBLE, 'infinity'::DOUBLE, 1::DOUBLE FROM f
  UNION ALL
  SELECT q, n + 1, CASE WHEN more THEN low ELSE rate END, CASE WHEN more THEN rate ELSE high END,
    CASE WHEN more THEN (low + rate) / 2 WHEN isinf(high) THEN 2 * rate ELSE (rate + high) / 2 END
  FROM (SELECT s.*, list_sum(list_transform(f.far, lambda x: exp(-x / greatest(s.rate, 1e-300::DOUBLE)))) > log2(15) AS more FROM s JOIN f USING (q) WHERE n < 64)),
w AS (SELECT m.q AS a, g AS b, exp(-beyond / greatest(rate, 1e-3::DOUBLE * mean)) AS w FROM m JOIN s ON m.q = s.q AND n = 64 JOIN f ON f.q = m.q),
u AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w)
SELECT a, b, round(sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END, 6) AS weight FROM u GROUP BY a, b"""


def _taps(new: int) -> str:
    """(o, i, w): the weight of an old place for a new one, by a triangle filter."""
    scale = f"({SIDE}::DOUBLE / {new})"
    w = f"greatest(0, 1 - abs(i - ((o + 0.5::DOUBLE) * {scale} - 0.5::DOUBLE)) / greatest(1, {scale}))"
    return f"w AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {w} AS w FROM range(0, {new}) a(o), range(0, {SIDE}) b(i)))"


def _resized(new: int) -> str:
    return f"""{_TILES}, {_taps(new)},
r AS (SELECT image, a.o AS y, b.o AS x, sum((v + 1) * 127.5::DOUBLE * a.w * b.w) AS v FROM t JOIN w a ON t.y = a.i JOIN w b ON t.x = b.i GROUP BY image, a.o, b.o)"""


_STEPS = f"""WITH {_L}, g AS (SELECT label, pos, avg(v) AS w, coalesce(avg(v) FILTER (vec_id % 2 = 0), 0) AS g0, coalesce(avg(v) FILTER (vec_id % 2 = 1), 0) AS g1 FROM l GROUP BY label, pos),
a AS (SELECT *, w * (1 - {LR * DECAY!r}::DOUBLE) - {LR}::DOUBLE * g0 / (abs(g0) + 1e-8::DOUBLE) AS w1 FROM g),
b AS (SELECT *, (0.09::DOUBLE * g0 + 0.1::DOUBLE * g1) / 0.19::DOUBLE AS m, (0.000999::DOUBLE * g0 * g0 + 0.001::DOUBLE * g1 * g1) / 0.001999::DOUBLE AS s FROM a)"""


def _trials() -> str:
    columns = []
    for name, (kind, *bounds) in training.SPACE.items():
        u = f"({draw_sql(f"'t:42:' || trial_id || ':{name}'")} / 268435456.0::DOUBLE)"
        if kind == "int":
            columns.append(f"CAST({bounds[0]} + floor({u} * {bounds[1] - bounds[0] + 1}) AS INT) AS {name}")
        elif kind == "log":
            columns.append(f"exp(ln({bounds[0]}::DOUBLE) + {u} * (ln({bounds[1]}::DOUBLE) - ln({bounds[0]}::DOUBLE))) AS {name}")
        elif kind == "float":
            columns.append(f"{bounds[0]}::DOUBLE + {u} * ({bounds[1]}::DOUBLE - {bounds[0]}::DOUBLE) AS {name}")
        else:
            columns.append(f"CAST({bounds}[1 + CAST(floor({u} * {len(bounds)}) AS INT)] AS INT) AS {name}")
    return f"WITH tr AS (SELECT trial_id, {', '.join(columns)} FROM range(0, {N_TRIALS}) r(trial_id))"


ORACLE_SQL = {
    "l2_normalize": f"{_NORM} SELECT vec_id, CAST(pos AS INT) AS pos, round(v * 3 / greatest(n, 1e-12), 6) AS x FROM l JOIN n USING (vec_id)",
    "l2_normalize_raw": f"{_NORM} SELECT vec_id, CAST(pos AS INT) AS pos, round(v * 3 / n, 6) AS x FROM l JOIN n USING (vec_id)",
    "conditional_normalize": f"{_NORM} SELECT vec_id, CAST(pos AS INT) AS pos, round(CASE WHEN label % 2 = 0 THEN v * 3 ELSE v * 3 / n END, 6) AS x FROM l JOIN n USING (vec_id)",
    "token_mean_pool": f"WITH {_L} SELECT vec_id, CAST(pos % 8 AS INT) AS pos, round(avg(v), 6) AS x FROM l GROUP BY vec_id, pos % 8",
    "pooled_or_mean": f"WITH {_L} SELECT vec_id, CAST(pos % 8 AS INT) AS pos, round(CASE WHEN any_value(label) % 2 = 0 THEN max(v) FILTER (pos < 8) ELSE avg(v) END, 6) AS x FROM l GROUP BY vec_id, pos % 8",
    "head_forward": f"{_HEAD} SELECT vec_id, CAST(j AS INT) AS pos, round(x, 6) AS x FROM o",
    "embed": f"{_HEAD} SELECT vec_id, CAST(j AS INT) AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS x FROM o",
    "pixel_normalize": f"{_TILES} SELECT image, y, x, round((v - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS v FROM t",
    "hflip": f"{_TILES} SELECT image, y, 7 - x AS x, round(v, 6) AS v FROM t",
    "vflip": f"{_TILES} SELECT image, 7 - y AS y, x, round(v, 6) AS v FROM t",
    "mask_apply": f"{_TILES} SELECT image, y, x, round(CASE WHEN v > {THRESHOLD}::DOUBLE THEN 0 ELSE v END, 6) AS v FROM t",
    "mask_bbox": f"{_TILES}, {_BOX} SELECT * FROM b",
    "mask_crop": f"{_TILES}, {_BOX} SELECT image, y - ymin AS y, x - xmin AS x, round(v, 6) AS v FROM t JOIN b USING (image) WHERE y >= ymin AND y < ymax AND x >= xmin AND x < xmax",
    "background_replace": f"{_TILES} SELECT t.image, t.y, t.x, round(CASE WHEN t.v > {THRESHOLD}::DOUBLE THEN o.v ELSE t.v END, 6) AS v FROM t JOIN t o ON t.image = o.image AND t.y = o.y AND t.x = 7 - o.x",
    "resize_nearest": f"{_TILES} SELECT image, CAST(ny AS INT) AS y, CAST(nx AS INT) AS x, round(v, 6) AS v FROM t JOIN range(0, 4) a(ny) ON y = ny * 8 // 4 JOIN range(0, 4) b(nx) ON x = nx * 8 // 4",
    "eval_transform": f"""{_resized(SIDE // 2)} SELECT image, CAST(c AS INT) AS c, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round((v / 255 - m) / s, 6) AS v
  FROM r, (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE)) n(c, m, s)""",
    "resize_up": f"{_resized(3 * SIDE // 2)} SELECT image, 0 AS c, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS v FROM r",
    "jitter_tile": f"""{_TILES}, p AS (SELECT image, y, x, c, (v + 1) * 127.5::DOUBLE / (c + 1) AS v, (v + 1) * 127.5::DOUBLE AS top FROM t, range(0, 3) r(c)),
s AS (SELECT image, y, x, c, least(255, greatest(0, top * (0.299::DOUBLE + 0.587::DOUBLE / 2 + 0.114::DOUBLE / 3) * (1 - {FACTORS[2]}::DOUBLE) + v * {FACTORS[2]}::DOUBLE)) AS v FROM p),
b AS (SELECT image, y, x, c, least(255, v * {FACTORS[0]}::DOUBLE) AS v FROM s),
m AS (SELECT image, sum(v * CASE c WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END) / {SIDE * SIDE} AS m FROM b GROUP BY image)
SELECT image, CAST(c AS INT) AS c, y, x, round(least(255, greatest(0, m * (1 - {FACTORS[1]}::DOUBLE) + v * {FACTORS[1]}::DOUBLE)), 6) AS v FROM b JOIN m USING (image)""",
    "rotate_tile": f"""{_TILES}, p AS (SELECT t.image, t.y, t.x, CAST(round_even(cos(a) * (x - 3.5) - sin(a) * (y - 3.5) + 3.5, 0) AS INT) AS sx,
  CAST(round_even(sin(a) * (x - 3.5) + cos(a) * (y - 3.5) + 3.5, 0) AS INT) AS sy FROM t, (SELECT radians({image.DEGREES}::DOUBLE) AS a))
SELECT p.image, 0 AS c, p.y, p.x, round(coalesce((t.v + 1) * 127.5::DOUBLE, 0), 6) AS v FROM p LEFT JOIN t ON t.image = p.image AND t.y = sy AND t.x = sx""",
    "adamw_steps": f"{_STEPS} SELECT label, CAST(pos AS INT) AS pos, round(w1 * (1 - {LR * DECAY!r}::DOUBLE) - {LR}::DOUBLE * m / (sqrt(s) + 1e-8::DOUBLE), 9) AS value FROM b",
    "gray_to_rgb": f"{_TILES} SELECT image, y, x, round(v, 6) AS v, CAST(c AS INT) AS c FROM t, range(0, 3) r(c)",
    "best_checkpoint_flags": f"{_LOG} SELECT * FROM f",
    "best_checkpoint_final": f"{_LOG} SELECT run, max(epoch) FILTER (is_best_metric) AS best_metric_epoch, max(epoch) FILTER (is_best_loss) AS best_loss_epoch, max(epoch) FILTER (is_last) AS last_epoch FROM f GROUP BY run",
    "path_label": """WITH p AS (SELECT page_id, string_split(url, '/')[-2] AS class_name FROM pages),
c AS (SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS INT) AS label FROM (SELECT DISTINCT class_name FROM p))
SELECT page_id, class_name, label FROM p JOIN c USING (class_name)""",
    "augment_plan": f"{_PLAN} SELECT * FROM a",
    "augment_resume": f"""{_PLAN} SELECT path, class_name, n, out_name FROM a WHERE class_name NOT IN (
  SELECT class_name FROM a WHERE CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) < 8 GROUP BY class_name HAVING count(*) >= 16)""",
    "trial_space": f"{_trials()} SELECT * REPLACE (round(lr, 9) AS lr, round(weight_decay, 9) AS weight_decay, round(margin, 9) AS margin, round(dropout, 9) AS dropout) FROM tr",
    "best_trial": f"{_trials()} SELECT trial_id, epochs, output_dim, hidden_dim, P, K, round(margin - dropout, 9) AS objective FROM tr ORDER BY objective DESC, trial_id LIMIT 1",
    "fuzzy_graph": _FUZZY,
    "class_centroids": f"WITH {_L} SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM l GROUP BY label, pos",
}
