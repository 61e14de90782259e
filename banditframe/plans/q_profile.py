"""Queries of the data-set profile over lineitem: four numbers as features, the return flag as label."""

from __future__ import annotations

from pyspark.sql import functions as F

from banditframe.operators import profile as P
from banditframe.plans.tables import cut, table

Q, SQL = {}, {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CELLS = "cells AS (SELECT unnest([0, 1, 2, 3]) AS f, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v, l_returnflag AS y FROM lineitem)"
#: Steps are numbered from one half, as both engines round it away from zero; half-way points stay off the data.
N = 333
BINS = f"{CELLS}, pe AS (SELECT f, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM cells GROUP BY f), b AS (SELECT cells.f, v, y, round_even(({N} / 10.0 - 1) * (v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 0) AS bin FROM cells JOIN pe USING (f))"
ENT = "SELECT {k} log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS levels FROM {t} {g}"
INFO = f"""{BINS}, xy AS (SELECT f, bin, y, count(*) AS n FROM b GROUP BY ALL), hxy AS ({ENT.format(k='f,', t='xy', g='GROUP BY f')}), hx AS ({ENT.format(k='f,', t='(SELECT f, bin, sum(n) AS n FROM xy GROUP BY ALL)', g='GROUP BY f')}),
hy AS ({ENT.format(k='f,', t='(SELECT f, y, sum(n) AS n FROM xy GROUP BY ALL)', g='GROUP BY f')}),
info AS (SELECT hx.f, hx.h AS hx, hx.h / CASE WHEN hx.levels > 1 THEN log2(hx.levels) ELSE 1 END AS hx_n, hxy.h AS hxy, hxy.h / CASE WHEN hxy.levels > 1 THEN log2(hxy.levels) ELSE 1 END AS hxy_n, hx.h + hy.h - hxy.h AS mi, hy.h AS hy, hx.levels FROM hx JOIN hxy USING (f) JOIN hy USING (f))"""


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, d):
    return table(spark, d, "lineitem").select(F.array(*FEATURES).alias("x"), F.col("l_returnflag").alias("y"))


def _cells(spark, d):
    return P.long_form(_rows(spark, d))


def _info(spark, d):
    return P.information(P.binned(_cells(spark, d), N))


def _round(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {BINS} SELECT f, bin::BIGINT AS bin, count(*) AS n FROM b GROUP BY ALL")
def m0_bins(spark, d):
    return P.binned(_cells(spark, d), N).groupBy("f", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_returnflag) AS class_count, 4 AS feature_count FROM lineitem")
def m1_counts(spark, d):
    return _rows(spark, d).agg(F.countDistinct("y").alias("class_count"), F.max(F.size("x")).alias("feature_count"))


CLS = "WITH c AS (SELECT l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS t, sum(n * log2(n)) AS e FROM c), o AS (SELECT sum(n / (t - n)) AS o FROM c, s)"


@query(f"{CLS} SELECT k AS class_count, round(log2(t) - e / t, 6) AS class_entropy, round((log2(t) - e / t) / log2(k), 6) AS class_entropy_n, round(1 - 1 / ((k - 1) / k::DOUBLE * o), 6) AS class_imbalance_ratio FROM s, o")
def m2_m3_m4_labels(spark, d):
    return _round(P.labels(_rows(spark, d)))


@query(f"WITH {INFO} SELECT count(*) FILTER (levels <> 2) AS feature_numeric_count, count(*) FILTER (levels = 2) AS feature_onehot_count, round(avg(hx), 6) AS feature_entropy_mean, round(avg(hx_n), 6) AS feature_entropy_mean_n, round(avg(hxy), 6) AS joint_entropy_mean, round(avg(hxy_n), 6) AS joint_entropy_mean_n, round(avg(mi), 6) AS mutual_info_mean, round((list(mi ORDER BY mi DESC))[1], 6) AS mutual_info_rank1, round((list(mi ORDER BY mi DESC))[2], 6) AS mutual_info_rank2, round(max(hy) / avg(mi), 3) AS equivalent_num_attr, round((avg(hx) - avg(mi)) / avg(mi), 3) AS noise_signal_ratio FROM info")
def m5_to_m9_information(spark, d):
    out = _round(P.information_summary(_info(spark, d)), 6)
    return out.withColumns({c: F.round(c, 3) for c in ("equivalent_num_attr", "noise_signal_ratio")})


@query(f"WITH {INFO} SELECT row_number() OVER (ORDER BY mi DESC, f)::INT AS rank, f, round(mi, 6) AS mi FROM info QUALIFY rank <= 2")
def m8_top_features(spark, d):
    return _round(P.ranked(_info(spark, d)))


@query(f"WITH {CELLS}, g AS (SELECT f, y, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM cells GROUP BY ALL), w AS (SELECT f, sum(n * m) / sum(n) AS mean FROM g GROUP BY f), r AS (SELECT f, sum(n * (m - mean) * (m - mean)) / sum(ss) AS r FROM g JOIN w USING (f) GROUP BY f) SELECT round(1 / (1 + max(r)), 6) AS max_fisher_discrim FROM r")
def m10_fisher(spark, d):
    return _round(P.fisher(_cells(spark, d)))


PAIRS = f"{CELLS}, e AS (SELECT f, y, min(v) AS lo, max(v) AS hi FROM cells GROUP BY ALL), pr AS (SELECT a.f, a.y AS y1, b.y AS y2, greatest(a.lo, b.lo) AS low, least(a.hi, b.hi) AS high, least(a.lo, b.lo) AS al, greatest(a.hi, b.hi) AS ah FROM e a JOIN e b ON a.f = b.f AND a.y < b.y)"


@query(f"WITH {PAIRS} SELECT round(avg(v), 6) AS volume_overlapping FROM (SELECT y1, y2, product(greatest(high - low, 0) / (ah - al)) AS v FROM pr WHERE ah > al GROUP BY ALL)")
def m11_volume_overlap(spark, d):
    return _round(P.volume_overlap(_cells(spark, d)))


@query(f"WITH {PAIRS} SELECT round(avg(s), 6) AS max_single_feature_eff FROM (SELECT y1, y2, min(sh) AS s FROM (SELECT y1, y2, pr.f, avg((v BETWEEN low AND high)::INT) AS sh FROM pr JOIN cells ON cells.f = pr.f AND (cells.y = y1 OR cells.y = y2) GROUP BY ALL) GROUP BY ALL)")
def m12_single_feature(spark, d):
    return _round(P.single_feature_efficiency(_cells(spark, d)))


@query("SELECT round(avg(((l_quantity <> 0)::INT + (l_extendedprice <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT) / 4), 6) AS percent_nonzero_feat FROM lineitem")
def m13_nonzero(spark, d):
    return _round(P.nonzero(_rows(spark, d)))


@query("SELECT count(DISTINCT 'lang=' || lang) + count(DISTINCT 'source=' || source) AS width, round(sum(n_chars) + 2 * count(*), 3)::DOUBLE AS total FROM documents")
def m14_dense_width(spark, d):
    docs = table(spark, d, "documents")
    one = F.lit(1.0)
    m = F.create_map(F.concat(F.lit("lang="), "lang"), F.col("n_chars").cast("double"), F.concat(F.lit("source="), "source"), one + 1)
    out = P.dense(docs.select(m.alias("m"), F.col("lang").alias("y")), "m")
    return out.agg(F.max(F.size("x")).cast("long").alias("width"), F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)), 3).alias("total"))


@query(r"""WITH w AS (SELECT doc_id, word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
k AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS f FROM (SELECT DISTINCT word FROM w)), s AS (SELECT doc_id, count(*) AS cells, sum(f * n) AS digest, max(f) AS last FROM w JOIN k USING (word) GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM k) AS size, coalesce(cells, 0) AS cells, coalesce(digest, 0) AS digest, last FROM documents d LEFT JOIN s USING (doc_id)""")
def m14_wide_sparse(spark, d):
    """Every word of the documents is a feature: sparse vectors over a dictionary of all words. Texts are dealt by document before they
    are split, so that words are counted and gathered where they are and not shuffled for it."""
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(F.split("text", "[ \\n]+")).alias("word")).filter("word <> ''")
    counts = docs.groupBy("doc_id", "word").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"))
    _, rows = P.indexed(table(spark, d, "documents").select("doc_id").join(maps, "doc_id", "left"), "m", "doc_id")
    digest = F.aggregate(F.zip_with("x.indices", "x.values", lambda f, v: f * v), F.lit(0.0), lambda a, v: a + v)
    return rows.select("doc_id", "x.size", F.size("x.indices").cast("long").alias("cells"), digest.alias("digest"), F.array_max("x.indices").alias("last"))


@query()
def m15_principal_components(spark, d):
    e = table(spark, d, "embeddings")
    return _round(P.principal(e.select(F.col("embedding").alias("x")), 64))


@query()
def m16_landmarks(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    return P.landmarks(cut(e))


@query("""WITH r AS (SELECT vec_id AS id, label AS y, vec_id % 5 AS fold, embedding FROM embeddings), c AS (SELECT id, y, fold, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM r), o AS (SELECT DISTINCT fold AS own FROM r),
m AS (SELECT own, y, k, avg(v) AS mu, var_pop(v) AS va FROM o JOIN c ON own <> fold GROUP BY ALL), n AS (SELECT own, y, ln(count(*) / sum(count(*)) OVER (PARTITION BY own)) AS prior FROM o JOIN r ON own <> fold GROUP BY own, y),
s AS (SELECT c.id, c.y, c.fold, m.y AS g, any_value(prior) - 0.5 * sum(ln(2 * pi() * va) + (v - mu) ^ 2 / va) AS z FROM c JOIN m ON m.own = c.fold AND m.k = c.k JOIN n ON n.own = c.fold AND n.y = m.y GROUP BY ALL),
p AS (SELECT id, y, fold, arg_max(g, z) AS predicted FROM s GROUP BY ALL),
l AS (SELECT fold, label, sum((y = label)::INT) AS n, sum((predicted = label)::INT) AS said, sum((y = label AND predicted = label)::INT) AS hit FROM p, (SELECT DISTINCT label FROM embeddings) GROUP BY ALL),
f AS (SELECT fold, sum(hit) / sum(n) AS accuracy, sum(CASE WHEN n + said > 0 THEN n * 2 * hit / (n + said) ELSE 0 END) / sum(n) AS f1 FROM l GROUP BY 1)
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1 FROM f""")
def m16_naive_bayes(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"), (F.col("vec_id") % 5).alias("fold"))
    out = P.scores(P.naive_bayes(e))
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))
