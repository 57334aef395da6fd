"""Queries over ``embeddings``: splits, batches, neighbours, recall, triplets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vector
from lodestar.functions.hashing import draw_sql
from lodestar.functions.vector import doubles
from lodestar.operators import mining, sampling, search, splits
from lodestar.sources.shared import settle

RATIO, SEED, P, K, MARGIN, KS = 0.3, 42, 4, 4, 0.7, (1, 3, 10)
#: Where ``knn_far_from_zero`` puts its vectors.
FAR = 1e6


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", doubles(F.col("embedding")).alias("embedding"))


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery), written once: several steps read either."""
    rows = settle(splits.per_class(items(spark, sf_dir), RATIO, SEED), "split")
    return rows.filter("is_query").drop("is_query"), rows.filter("not is_query").drop("is_query")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries, gallery = split(spark, sf_dir)
    return queries, gallery, search.knn(queries, gallery, max(KS))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _neighbours(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.knn(*split(spark, sf_dir), max(KS), metric)
        return _rounded(found.select("q", "g", "rank", "ql", "gl", "d"), "d")

    return query


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = items(spark, sf_dir)
    batches = settle(sampling.pk_batches(rows, P, K, SEED), "batches")
    return batches, mining.batch_pairs(batches, rows)


def _labels(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).select("vec_id", "label")


def class_index(spark, sf_dir):
    return splits.class_index(_labels(spark, sf_dir)).select("label", "pos", "vec_id", "n")


def class_counts(spark, sf_dir):
    return splits.class_counts(_labels(spark, sf_dir))


def split_per_class(spark, sf_dir):
    return splits.per_class(_labels(spark, sf_dir), RATIO, SEED).select("vec_id", "label", "is_query")


def split_positional(spark, sf_dir):
    return splits.positional(_labels(spark, sf_dir), RATIO, SEED).select("vec_id", "label", "block", "side")


def split_group_summary(spark, sf_dir):
    rows = splits.positional(_labels(spark, sf_dir), RATIO, SEED)
    return rows.groupBy("block", "side").agg(F.count(F.lit(1)).alias("n"))


def subset_reindex(spark, sf_dir):
    _, gallery = split(spark, sf_dir)
    return splits.subset_index(_labels(spark, sf_dir), gallery).select("label", "pos", "vec_id", "n")


def batch_scan(spark, sf_dir):
    return splits.batch_scan(_labels(spark, sf_dir), 32).select("vec_id", "batch", "slot")


def pk_batches(spark, sf_dir):
    return sampling.pk_batches(_labels(spark, sf_dir), P, K, SEED)


def pk_wraparound(spark, sf_dir):
    return sampling.pk_batches(_labels(spark, sf_dir), 2, 256, SEED)


def gemm_knn(spark, sf_dir):
    """All rows as queries, 5 neighbours each."""
    rows = items(spark, sf_dir)
    return _rounded(search.knn(rows, rows, 5, same=True).select("q", "g", "rank", "d"), "d")


def knn_unrolled(spark, sf_dir):
    """The search inside generated code; the queries are broadcast once their size is checked."""
    found = search.knn_pairs(*split(spark, sf_dir), max(KS))
    return _rounded(found.select("q", "g", "rank", "ql", "gl", "d"), "d")


def cosine_knn_graph_15(spark, sf_dir):
    rows = items(spark, sf_dir)
    return _rounded(search.knn(rows, rows, 15, "cosine", same=True).select("q", "g", "rank", "d"), "d")


def _altered(how):
    """The split with its vectors altered."""

    def of(spark, sf_dir):
        return [side.withColumn("embedding", how(F.col("embedding"), F.col("vec_id"))) for side in split(spark, sf_dir)]

    return of


_far = _altered(lambda v, k: F.transform(v, lambda x: x * 1e-3 + FAR))
_some_zero = _altered(lambda v, k: F.transform(v, lambda x: F.when(k % 5 == 0, 0.0).otherwise(x)))


def knn_far_from_zero(spark, sf_dir):
    """Vectors a thousandth as wide, a million away from zero: nothing of their distances is left in their norms."""
    found = search.knn(*_far(spark, sf_dir), max(KS))
    return found.select("q", "g", "rank", "ql", "gl", F.round("d", 9).alias("d"))


def knn_zero_vectors(spark, sf_dir):
    """Every fifth vector is zero; its cosine distance to any other is 1."""
    return _rounded(search.knn(*_some_zero(spark, sf_dir), max(KS), "cosine").select("q", "g", "rank", "ql", "gl", "d"), "d")


def knn_registered_metric(spark, sf_dir):
    """The search by a metric that the library doesn't have: the sum of absolute differences."""
    vector.register_metric("l1", lambda a, b, dim: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x), lambda x, y: np.abs(x - y))
    return _rounded(search.knn(*split(spark, sf_dir), max(KS), "l1").select("q", "g", "rank", "ql", "gl", "d"), "d")


def recall_at_k(spark, sf_dir):
    queries, _, found = _both(spark, sf_dir)
    return search.recall(queries, found, KS)


def recall_at_k_long(spark, sf_dir):
    queries, _, found = _both(spark, sf_dir)
    return search.recall_long(queries, found, KS)


def mean_recall(spark, sf_dir):
    return recall_at_k_long(spark, sf_dir).agg(F.round(F.avg("recall"), 9).alias("mean_recall"))


def recall_per_class(spark, sf_dir):
    queries, _, found = _both(spark, sf_dir)
    return search.recall_per_class(queries, found, KS)


def recall_pk_gallery(spark, sf_dir):
    """The gallery is what the sampler drew, as in evaluation between epochs."""
    rows = items(spark, sf_dir)
    queries, gallery = split(spark, sf_dir)
    drawn = sampling.pk_batches(gallery, P, K, SEED).select("vec_id").distinct()
    found = search.knn(queries, rows.join(drawn, "vec_id", "left_semi"), max(KS))
    return search.recall(queries, found, KS)


def batch_pairs(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir)[1], "d", "d_shifted")


def positives(spark, sf_dir):
    return _rounded(mining.positives(_pairs(spark, sf_dir)[1]), "d_ap")


def negatives(spark, sf_dir):
    return _rounded(mining.negatives(_pairs(spark, sf_dir)[1]), "d_an")


def _semi_hard(spark, sf_dir):
    batches, pairs = _pairs(spark, sf_dir)
    return batches, mining.semi_hard(pairs, MARGIN)


def semi_hard_triplets(spark, sf_dir):
    return _rounded(_semi_hard(spark, sf_dir)[1].drop("s_ap", "s_an"), "d_ap", "d_an")


def hard_triplets(spark, sf_dir):
    return _rounded(mining.hard(_pairs(spark, sf_dir)[1], SEED).drop("s_ap", "s_an"), "d_ap", "d_an")


def hard_triplets_closest(spark, sf_dir):
    return _rounded(mining.hard(_pairs(spark, sf_dir)[1], SEED, True).drop("s_ap", "s_an"), "d_ap", "d_an")


def triplet_loss(spark, sf_dir):
    stats = mining.batch_stats(_semi_hard(spark, sf_dir)[1], MARGIN)
    return _rounded(stats.select("batch", "triplets", "loss"), "loss")


def pos_neg_dist(spark, sf_dir):
    stats = mining.batch_stats(_semi_hard(spark, sf_dir)[1], MARGIN)
    return _rounded(stats.select("batch", "mean_pos_dist", "mean_neg_dist"), "mean_pos_dist", "mean_neg_dist")


def epoch_rollup(spark, sf_dir):
    """With a margin so small that batches may be without triplets; they stay in the divisor."""
    batches, pairs = _pairs(spark, sf_dir)
    stats = mining.batch_stats(mining.semi_hard(pairs, 1e-3), 1e-3)
    return _rounded(mining.epoch_rollup(batches, stats), "loss", "mean_pos_dist", "mean_neg_dist")


QUERIES = {
    f.__name__: f
    for f in (
        class_index, class_counts, split_per_class, split_positional, split_group_summary, subset_reindex, batch_scan, pk_batches,
        pk_wraparound, recall_at_k, recall_at_k_long, mean_recall, recall_per_class, recall_pk_gallery, gemm_knn, knn_unrolled,
        knn_far_from_zero, knn_zero_vectors, knn_registered_metric,
        cosine_knn_graph_15, batch_pairs, positives, negatives, semi_hard_triplets, hard_triplets, hard_triplets_closest,
        triplet_loss, pos_neg_dist, epoch_rollup,
    )
} | {f"knn_topk_{m}": _neighbours(m) for m in ("l2", "cosine", "ip")}

# -- the same rows in SQL --------------------------------------------------------------------------------

_ITEMS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_INDEX = "x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM {0})"
_SPLIT = f"""{_ITEMS}, {_INDEX.format("e")},
s AS (SELECT vec_id, label, v, (pos - {draw_sql(f"'split:{SEED}:' || label")} % n + n) % n < floor(n * {RATIO}::DOUBLE) AS is_query FROM x)"""


def _sum(expression: str) -> str:
    return f"list_reduce(list_transform(list_zip({{a}}, {{b}}), lambda z: {expression}), lambda s, t: s + t, 0.0::DOUBLE)"


def _l2(a: str, b: str, shift: str = "") -> str:
    return "sqrt(" + _sum(f"(z[1] - z[2]{shift}) * (z[1] - z[2]{shift})").format(a=a, b=b) + ")"


def _dot(a: str, b: str) -> str:
    return _sum("z[1] * z[2]").format(a=a, b=b)


_METRICS = {
    "l2": _l2("q.v", "g.v"),
    "ip": f"-{_dot('q.v', 'g.v')}",
    "cosine": f"1.0::DOUBLE - CASE WHEN {_dot('q.v', 'q.v')} * {_dot('g.v', 'g.v')} = 0 THEN 0 ELSE {_dot('q.v', 'g.v')} / (sqrt({_dot('q.v', 'q.v')}) * sqrt({_dot('g.v', 'g.v')})) END",
}
_L1 = _sum("abs(z[1] - z[2])").format(a="q.v", b="g.v")


def _knn(metric: str, queries: str, gallery: str, k: int, on: str = "true") -> str:
    return f"""d AS (SELECT q.vec_id AS q, g.vec_id AS g, q.label AS ql, g.label AS gl, {_METRICS.get(metric, metric)} AS d FROM {queries} q JOIN {gallery} g ON {on}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, g) AS rank FROM d) WHERE rank <= {k})"""


_QG = "(SELECT * FROM s WHERE is_query)", "(SELECT * FROM s WHERE NOT is_query)"
_RECALL = f"""WITH {_SPLIT}, {{knn}},
h AS (SELECT vec_id, label, (SELECT min(rank) FROM nn WHERE nn.q = s.vec_id AND ql = gl) AS hit FROM s WHERE is_query)"""
_SHARES = ", ".join(f"avg((coalesce(hit, 1 << 30) <= {k})::INT::DOUBLE) AS recall_{k}" for k in KS)
_LONG = " UNION ALL ".join(f"SELECT {k} AS k, avg((coalesce(hit, 1 << 30) <= {k})::INT::DOUBLE) AS recall FROM h" for k in KS)


def _pk(source: str, p: int, k: int) -> str:
    """Floyd's algorithm, one column for each of ``p`` draws."""
    draws = []
    for i in range(p):
        t = f"({draw_sql(f"'c:{SEED}:' || batch || ':{i}'")} % (c - {p - 1 - i}))"
        seen = " OR ".join(f"{t} = r{j}" for j in range(i)) or "false"
        draws.append(f"SELECT *, CASE WHEN {seen} THEN c - {p - i} ELSE {t} END AS r{i} FROM")
    nested = f"(SELECT batch, c FROM (SELECT count(DISTINCT label) AS c FROM {source}), range(0, 1 << 20) r(batch) WHERE batch < c // {p})"
    for step in draws:
        nested = f"({step} {nested})"
    chosen = " UNION ALL ".join(f"SELECT batch, {i} AS ci, r{i} AS rank FROM dr" for i in range(p))
    return f"""{_INDEX.format(source)}, dr AS (SELECT * FROM {nested}), ch AS ({chosen}),
cl AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS rank, any_value(n) AS n FROM x GROUP BY label),
pk AS (SELECT batch, CAST(ci * {k} + k AS INT) AS slot, x.vec_id, x.label FROM ch JOIN cl USING (rank) JOIN range(0, {k}) r(k) ON true
  JOIN x ON x.label = cl.label AND x.pos = ({draw_sql(f"'s:{SEED}:' || batch || ':' || cl.label")} % cl.n + k) % cl.n)"""


_PAIRS = f"""WITH {_ITEMS}, {_pk("e", P, K)},
bv AS (SELECT batch, slot, pk.label, v FROM pk JOIN e USING (vec_id)),
pr AS (SELECT q.batch, q.slot AS a, g.slot AS b, q.label = g.label AS same, {_l2("q.v", "g.v")} AS d, {_l2("q.v", "g.v", " + 1e-6::DOUBLE")} AS d_shifted
  FROM bv q JOIN bv g ON q.batch = g.batch AND q.slot <> g.slot),
ap AS (SELECT batch, a, b AS p, d AS d_ap, d_shifted AS s_ap FROM pr WHERE same),
an AS (SELECT batch, a, b AS n, d AS d_an, d_shifted AS s_an FROM pr WHERE NOT same)"""


def _band(margin: float) -> str:
    return f"t AS (SELECT batch, a, p, n, d_ap, d_an, s_ap, s_an FROM ap JOIN an USING (batch, a) WHERE d_an > d_ap AND d_an < d_ap + {margin}::DOUBLE)"


def _stats(margin: float) -> str:
    return f"""{_band(margin)}, st AS (SELECT batch, count(*) AS triplets, avg(greatest(s_ap - s_an + {margin}::DOUBLE, 0)) AS loss,
  avg(s_ap) AS mean_pos_dist, avg(s_an) AS mean_neg_dist FROM t GROUP BY batch)"""


_ONE = f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, a ORDER BY {draw_sql(f"'p:{SEED}:' || batch || ':' || a || ':' || p")}, p) AS r FROM ap) WHERE r = 1)"
_HARD = f"{_ONE}, t AS (SELECT batch, a, p, n, d_ap, d_an FROM one JOIN an USING (batch, a) WHERE d_an < d_ap)"
_POSITIONAL = f"""WITH {_ITEMS}, c AS (SELECT count(DISTINCT label) AS classes, count(*) // count(DISTINCT label) AS size FROM e),
r AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS rn FROM e),
b AS (SELECT *, rn // size AS block, rn % size AS off FROM r, c),
p AS (SELECT vec_id, label, block, CASE WHEN block >= classes THEN 'dropped'
  WHEN (off - {draw_sql(f"'pos:{SEED}:' || block")} % size + size) % size < floor(size * {RATIO}::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM b)"""

ORACLE_SQL = {
    "class_index": f"WITH {_ITEMS}, {_INDEX.format('e')} SELECT label, pos, vec_id, n FROM x",
    "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "split_per_class": f"WITH {_SPLIT} SELECT vec_id, label, is_query FROM s",
    "split_positional": f"{_POSITIONAL} SELECT * FROM p",
    "split_group_summary": f"{_POSITIONAL} SELECT block, side, count(*) AS n FROM p GROUP BY block, side",
    "subset_reindex": f"WITH {_SPLIT}, y AS (SELECT vec_id, label FROM s WHERE NOT is_query), {_INDEX.format('y').replace('x AS', 'z AS')} SELECT label, pos, vec_id, n FROM z",
    "batch_scan": "SELECT vec_id, (rn - 1) // 32 AS batch, CAST((rn - 1) % 32 AS INT) AS slot FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)",
    "pk_batches": f"WITH {_ITEMS}, {_pk('e', P, K)} SELECT * FROM pk",
    "pk_wraparound": f"WITH {_ITEMS}, {_pk('e', 2, 256)} SELECT * FROM pk",
    "knn_unrolled": f"WITH {_SPLIT}, {_knn('l2', *_QG, max(KS))} SELECT q, g, CAST(rank AS INT) AS rank, ql, gl, round(d, 6) AS d FROM nn",
    "gemm_knn": f"WITH {_ITEMS}, {_knn('l2', 'e', 'e', 5, 'q.vec_id <> g.vec_id')} SELECT q, g, CAST(rank AS INT) AS rank, round(d, 6) AS d FROM nn",
    "cosine_knn_graph_15": f"WITH {_ITEMS}, {_knn('cosine', 'e', 'e', 15, 'q.vec_id <> g.vec_id')} SELECT q, g, CAST(rank AS INT) AS rank, round(d, 6) AS d FROM nn",
    "knn_far_from_zero": f"WITH {_SPLIT}, f AS (SELECT * REPLACE (list_transform(v, lambda x: x * 1e-3::DOUBLE + {FAR}::DOUBLE) AS v) FROM s), {_knn('l2', *(x.replace('FROM s', 'FROM f') for x in _QG), max(KS))} SELECT q, g, CAST(rank AS INT) AS rank, ql, gl, round(d, 9) AS d FROM nn",
    "knn_zero_vectors": f"WITH {_SPLIT}, f AS (SELECT * REPLACE (list_transform(v, lambda x: CASE WHEN vec_id % 5 = 0 THEN 0 ELSE x END) AS v) FROM s), {_knn('cosine', *(x.replace('FROM s', 'FROM f') for x in _QG), max(KS))} SELECT q, g, CAST(rank AS INT) AS rank, ql, gl, round(d, 6) AS d FROM nn",
    "knn_registered_metric": f"WITH {_SPLIT}, {_knn(_L1, *_QG, max(KS))} SELECT q, g, CAST(rank AS INT) AS rank, ql, gl, round(d, 6) AS d FROM nn",
    "recall_at_k": f"{_RECALL.format(knn=_knn('l2', *_QG, max(KS)))} SELECT {_SHARES} FROM h",
    "recall_at_k_long": f"{_RECALL.format(knn=_knn('l2', *_QG, max(KS)))} {_LONG}",
    "mean_recall": f"{_RECALL.format(knn=_knn('l2', *_QG, max(KS)))} SELECT round(avg(recall), 9) AS mean_recall FROM ({_LONG})",
    "recall_per_class": f"{_RECALL.format(knn=_knn('l2', *_QG, max(KS)))} SELECT label, count(*) AS n_queries, {_SHARES} FROM h GROUP BY label",
    "recall_pk_gallery": _RECALL.replace("{knn}", f"ga AS (SELECT vec_id, label FROM s WHERE NOT is_query), {_pk('ga', P, K).replace('x AS', 'xx AS').replace('FROM x ', 'FROM xx ').replace('JOIN x ON', 'JOIN xx x ON')}, {_knn('l2', _QG[0], '(SELECT * FROM s WHERE vec_id IN (SELECT vec_id FROM pk))', max(KS))}") + f" SELECT {_SHARES} FROM h",
    "batch_pairs": f"{_PAIRS} SELECT batch, a, b, same, round(d, 6) AS d, round(d_shifted, 6) AS d_shifted FROM pr",
    "positives": f"{_PAIRS} SELECT batch, a, p, round(d_ap, 6) AS d_ap FROM ap",
    "negatives": f"{_PAIRS} SELECT batch, a, n, round(d_an, 6) AS d_an FROM an",
    "semi_hard_triplets": f"{_PAIRS}, {_band(MARGIN)} SELECT batch, a, p, n, round(d_ap, 6) AS d_ap, round(d_an, 6) AS d_an FROM t",
    "hard_triplets": f"{_PAIRS}, {_HARD} SELECT batch, a, p, n, round(d_ap, 6) AS d_ap, round(d_an, 6) AS d_an FROM t",
    "hard_triplets_closest": f"""{_PAIRS}, {_HARD} SELECT batch, a, p, n, round(d_ap, 6) AS d_ap, round(d_an, 6) AS d_an
FROM (SELECT *, row_number() OVER (PARTITION BY batch, a ORDER BY d_an, n) AS r FROM t) WHERE r = 1""",
    "triplet_loss": f"{_PAIRS}, {_stats(MARGIN)} SELECT batch, triplets, round(loss, 6) AS loss FROM st",
    "pos_neg_dist": f"{_PAIRS}, {_stats(MARGIN)} SELECT batch, round(mean_pos_dist, 6) AS mean_pos_dist, round(mean_neg_dist, 6) AS mean_neg_dist FROM st",
    "epoch_rollup": f"""{_PAIRS}, {_stats(1e-3)} SELECT round(sum(coalesce(loss, 0)) / count(*), 6) AS loss, round(sum(coalesce(mean_pos_dist, 0)) / count(*), 6) AS mean_pos_dist,
  round(sum(coalesce(mean_neg_dist, 0)) / count(*), 6) AS mean_neg_dist, CAST(coalesce(sum(triplets), 0) AS BIGINT) AS triplets_mined, count(*) AS batches
FROM (SELECT DISTINCT batch FROM pk) LEFT JOIN st USING (batch)""",
} | {
    f"knn_topk_{m}": f"WITH {_SPLIT}, {_knn(m, *_QG, max(KS))} SELECT q, g, CAST(rank AS INT) AS rank, ql, gl, round(d, 6) AS d FROM nn"
    for m in _METRICS
}
