"""Task typing, folds, training, scoring, clustering and reduction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import clusters as C
from ..operators import contributions as R
from ..operators import estimators as E
from ..operators import linkage as L
from ..operators import pairs as N
from ..operators import reduce as D
from ..operators import tuning as T
from ..operators.dbscan import dbscan
from ..operators.evaluate import classification_metrics, regression_metrics
from ..operators.hashing import fit_index
from ..operators.prepare import LabelEncoder, Scaler
from ..operators.retrain import update_model
from ..sources.registry import ModelStore
from ..streaming import monitoring as S
from .base import SQL, query, rounded, table, union_sql

DIMS = 64
AXES = [f"e{i}" for i in range(DIMS)]


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def embedding_columns(spark, sf):
    wide = [F.col("embedding")[i].alias(a) for i, a in enumerate(AXES)]
    return embeddings(spark, sf).select("vec_id", *wide, F.col("label").cast("long").alias("cluster"))


def lines(spark, sf):
    """Line items with a row id, class and number labels."""
    row_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")
    flags = F.array(*map(F.lit, "ANR"))
    return table(spark, sf, "lineitem").select(
        row_id.alias("row_id"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_linenumber",
        "l_extendedprice",
        F.datediff("l_shipdate", F.lit("1992-01-01")).alias("ship_day"),
        (F.array_position(flags, F.col("l_returnflag")) - 1).cast("double").alias("flag"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
    )


NUMBERS = ["l_quantity", "l_discount", "l_tax", "ship_day"]


def texts(spark, sf, unlabelled=False):
    """Documents with a few text measures: those with a label, or all of them."""
    t = F.col("text")
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / F.greatest(F.length(t), F.lit(1))
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.ln(F.col("n_chars") + 1).alias("size"),
        share("[^0-9]").alias("digits"),
        share(r"[^\n]").alias("breaks"),
        share("[^A-Z]").alias("capitals"),
        "lang",
    )
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return docs.join(labels, "doc_id", "left" if unlabelled else "inner")


MEASURES = ["size", "digits", "breaks", "capitals"]


@query(
    "label_tasks",
    """SELECT 'l_returnflag' AS label, 'classification' AS task, count(*) AS n FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) < 10 THEN 'classification' ELSE 'regression' END, count(*) FROM lineitem
UNION ALL SELECT 'l_quantity', CASE WHEN count(DISTINCT l_quantity) < 100 AND bool_and(l_quantity % 1 = 0) THEN 'classification' ELSE 'regression' END, count(*) FROM lineitem
UNION ALL SELECT 'l_extendedprice', CASE WHEN count(DISTINCT l_extendedprice) < 100 THEN 'classification' ELSE 'regression' END, count(*) FROM lineitem""",
)
def label_tasks(spark, sf):
    df = table(spark, sf, "lineitem")
    parts = [
        df.agg(F.lit(c).alias("label"), F.lit(T.label_task(df, c)).alias("task"), F.count("*").alias("n"))
        for c in ("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "table_tasks",
    """SELECT 'none' AS target, 'clustering' AS task, count(*) AS n FROM orders
UNION ALL SELECT 'o_orderstatus', 'classification', count(*) FROM orders
UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 10 THEN 'classification' ELSE 'regression' END, count(*) FROM orders""",
)
def table_tasks(spark, sf):
    df = table(spark, sf, "orders")
    rows = [df.agg(F.lit(n).alias("target"), F.lit(T.detect_task(df, n)).alias("task"), F.count("*").alias("n"))
            for n in ("none", "o_orderstatus", "o_totalprice")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "optimal_settings",
    """SELECT count(*) AS "rows", CAST(CASE WHEN count(*) < 1000 THEN 300 WHEN count(*) < 10000 THEN 1800 ELSE 3600 END AS INTEGER) AS max_training_time,
  CAST(CASE WHEN count(*) < 5000 THEN 3 ELSE 5 END AS INTEGER) AS cv_folds, FALSE AS enable_feature_selection FROM orders""",
)
def optimal_settings(spark, sf):
    return T.optimal_settings(table(spark, sf, "orders"), 6)


@query(
    "stratified_folds",
    """SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) - 1) % 5 AS INTEGER) AS fold
FROM events""",
)
def stratified_folds(spark, sf):
    return T.with_folds(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 5, "event_type")


@query(
    "plain_folds",
    """SELECT event_id, CAST((row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) - 1) % 3 AS INTEGER) AS fold FROM events""",
)
def plain_folds(spark, sf):
    return T.with_folds(table(spark, sf, "events").select("event_id"), "event_id", 3)


_NEAR_SQL = """near AS (SELECT * FROM (SELECT a.vec_id AS key, b.vec_id AS neighbour,
  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS INTEGER) AS place
  FROM embeddings a JOIN embeddings b ON {on}) WHERE place <= {k})"""


@query(
    "nearest_neighbours",
    f"WITH {_NEAR_SQL.format(on='a.vec_id <> b.vec_id', k=5)} SELECT key, neighbour, round(distance, 6) AS distance, place FROM near",
)
def nearest_neighbours(spark, sf):
    v = N.vectors(embeddings(spark, sf), "vec_id", "embedding")
    return rounded(N.nearest(v, v, "vec_id", 5), 6, "distance")


_VOTE_SQL = f"""WITH {_NEAR_SQL.format(on='a.vec_id % 2 = 1 AND b.vec_id % 2 = 0', k=7)},
votes AS (SELECT key, label, count(*) AS n FROM near JOIN embeddings ON vec_id = neighbour GROUP BY 1, 2)
SELECT key AS vec_id, CAST(label AS DOUBLE) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1"""


@query("neighbour_vote", _VOTE_SQL)
def neighbour_vote(spark, sf):
    """Small blocks, so that several meet."""
    v = N.vectors(embeddings(spark, sf), "vec_id", "embedding", ["label"])
    return N.neighbour_vote(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "vec_id", "label", 7, block_rows=128)


@query(
    "neighbour_mean",
    f"""WITH {_NEAR_SQL.format(on='a.vec_id % 2 = 1 AND b.vec_id % 2 = 0', k=7)}
SELECT key AS vec_id, round(sum(label / distance) / sum(1 / distance), 6) AS prediction FROM near JOIN embeddings ON vec_id = neighbour GROUP BY 1""",
)
def neighbour_mean(spark, sf):
    v = N.vectors(embeddings(spark, sf), "vec_id", "embedding", ["label"])
    out = N.neighbour_vote(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "vec_id", "label", 7, "distance", classify=False)
    return rounded(out, 6, "prediction")


@query("hashed_neighbours")
def hashed_neighbours(spark, sf):
    """The ten nearest rows of every row through an index of random projections."""
    v = N.vectors(embeddings(spark, sf), "vec_id", "embedding")
    return fit_index(v, "vec_id", most=10).nearest(v, 10)


@query("hashed_neighbour_recall", "SELECT count(*) AS n, CAST(20 AS INTEGER) AS k, TRUE AS reached FROM embeddings")
def hashed_neighbour_recall(spark, sf):
    """Whether the index finds nine of ten true neighbours, as measured at fit."""
    v = N.vectors(embeddings(spark, sf), "vec_id", "embedding")
    index = fit_index(v, "vec_id", most=20, recall=0.9)
    return v.agg(F.count("*").alias("n"), F.lit(index.most).alias("k"), F.lit(index.recall >= 0.9).alias("reached"))


_CELLS_SQL = """cells AS (SELECT vec_id, label AS c, unnest(range(64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
mid AS (SELECT c, d, avg(x) AS m, count(*) AS n FROM cells GROUP BY 1, 2)"""


@query(
    "calinski_harabasz",
    f"""WITH {_CELLS_SQL}, al AS (SELECT d, avg(x) AS g FROM cells GROUP BY 1),
b AS (SELECT sum(n * (m - g) ** 2) AS b FROM mid JOIN al USING (d)),
w AS (SELECT sum((x - m) ** 2) AS w FROM cells JOIN mid USING (c, d)),
k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)
SELECT k AS n_clusters, round(b * (n - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, w, k""",
)
def calinski_harabasz(spark, sf):
    return rounded(C.calinski_harabasz(embedding_columns(spark, sf), AXES, "cluster"), 6, "calinski_harabasz")


@query(
    "davies_bouldin",
    f"""WITH {_CELLS_SQL}, s AS (SELECT c, avg(r) AS s FROM (SELECT c, vec_id, sqrt(sum((x - m) ** 2)) AS r FROM cells JOIN mid USING (c, d) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) ** 2)) AS g FROM mid a JOIN mid b ON a.d = b.d AND a.c <> b.c GROUP BY 1, 2)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / g) AS w FROM g JOIN s x ON x.c = a JOIN s y ON y.c = b GROUP BY 1)""",
)
def davies_bouldin(spark, sf):
    return rounded(C.davies_bouldin(embedding_columns(spark, sf), AXES, "cluster"), 6, "davies_bouldin")


@query(
    "silhouette",
    """WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS t, count(*) AS n
  FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM p GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
)
def silhouette(spark, sf):
    df = embeddings(spark, sf).withColumnRenamed("label", "cluster")
    return rounded(C.silhouette(df, "vec_id", "embedding", "cluster", block_rows=256), 6, "silhouette")


_SQUARED_SQL = """p AS (SELECT a.vec_id, a.label AS own, b.label AS other, count(*) AS n,
  sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2) AS t FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
sides AS (SELECT vec_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM p GROUP BY 1)"""


@query("squared_silhouette", f"WITH {_SQUARED_SQL} SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM sides")
def squared_silhouette(spark, sf):
    """From one row per cluster; the SQL compares all rows."""
    return rounded(C.squared_silhouette(embedding_columns(spark, sf), AXES, "cluster"), 6, "silhouette")


@query(
    "cluster_report",
    f"""WITH ch AS ({SQL["calinski_harabasz"]}), db AS ({SQL["davies_bouldin"]}), {_SQUARED_SQL},
sq AS (SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM sides)
SELECT n_clusters, calinski_harabasz, davies_bouldin, silhouette, 'success' AS status FROM ch, db, sq""",
)
def cluster_report(spark, sf):
    out = C.cluster_metrics(embedding_columns(spark, sf), AXES, "cluster")
    return rounded(out, 6, "calinski_harabasz", "davies_bouldin", "silhouette")


def _clustered(spark, sf, name, params):
    df = embedding_columns(spark, sf).drop("cluster")
    model = E.fit_family(df, name, AXES, params=params)
    return model.transform(df).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


@query("kmeans")
def kmeans(spark, sf):
    return _clustered(spark, sf, "KMeans", {"k": 4})


@query("gaussian_mixture")
def gaussian_mixture(spark, sf):
    """On the first principal axes: a full covariance over all 64 needs far more rows."""
    df = embeddings(spark, sf)
    axes, _ = D.principal_components(df, "embedding", DIMS, 4)
    wide = D.project(df, "embedding", axes, "z").select("vec_id", *[F.col("z")[i].alias(f"z{i}") for i in range(4)])
    model = E.fit_family(wide, "GaussianMixture", [f"z{i}" for i in range(4)], params={"k": 3})
    return E.score(model, wide, ["vec_id"])


@query("bisecting_kmeans")
def bisecting_kmeans(spark, sf):
    return _clustered(spark, sf, "BisectingKMeans", {"k": 4})


@query(
    "single_linkage",
    """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x FROM customer),
o AS (SELECT id, x, x - lag(x) OVER (ORDER BY x, id) AS gap FROM c),
cuts AS (SELECT x, id FROM o ORDER BY gap DESC NULLS LAST LIMIT 7),
g AS (SELECT id, (SELECT count(*) FROM cuts WHERE cuts.x < c.x OR (cuts.x = c.x AND cuts.id <= c.id)) AS g FROM c),
f AS (SELECT g, min(id) AS first FROM g GROUP BY g)
SELECT id AS c_custkey, CAST((SELECT count(*) FROM f WHERE f.first < (SELECT first FROM f WHERE f.g = g.g)) AS INTEGER) AS cluster FROM g""",
)
def single_linkage(spark, sf):
    """Eight clusters of customers by balance. On a line single linkage cuts the widest gaps, which SQL can say."""
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    return L.single_linkage(df, "c_custkey", ["x"]).clusters(8)


@query("cluster_search")
def cluster_search(spark, sf):
    """Trials of two families over the first principal axes."""
    df = embeddings(spark, sf)
    axes, _ = D.principal_components(df, "embedding", DIMS, 4)
    names = [f"z{i}" for i in range(4)]
    wide = D.project(df, "embedding", axes, "z").select("vec_id", *[F.col("z")[i].alias(n) for i, n in enumerate(names)])
    fixed = {"KMeans": {"maxIter": 10}, "BisectingKMeans": {"k": 4, "maxIter": 5}}
    return T.search_clusters(wide, names, ["KMeans", "BisectingKMeans"], trials=1, fixed=fixed).trials


@query("density_clusters")
def density_clusters(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return dbscan(df, "c_custkey", ["x", "y"], eps=0.3, min_samples=5)


@query("principal_components")
def principal_components(spark, sf):
    df = embeddings(spark, sf)
    axes, shares = D.principal_components(df, "embedding", DIMS, 0.9)
    return D.component_table(df, shares)


@query("projected_axes")
def projected_axes(spark, sf):
    """The two first principal axes, for a cluster view."""
    df = embeddings(spark, sf)
    axes, _ = D.principal_components(df, "embedding", DIMS, 2)
    return D.project(df, "embedding", axes, "z").select("vec_id", F.col("z")[0].alias("x"), F.col("z")[1].alias("y"), "label")


@query("truncated_svd")
def truncated_svd(spark, sf):
    df = embeddings(spark, sf)
    axes, values = D.singular_vectors(df, "embedding", DIMS, 8)
    out = D.project(df, "embedding", axes, "z")
    return out.select("vec_id", "z", F.lit(float(values[0])).alias("largest_value"))


@query("reduction_metrics")
def reduction_metrics(spark, sf):
    df = embeddings(spark, sf)
    axes, shares = D.principal_components(df, "embedding", DIMS, 8)
    return C.reduction_metrics(D.project(df, "embedding", axes, "z"), "embedding", "z", axes, shares)


@query("neighbour_overlap")
def neighbour_overlap(spark, sf):
    df = embeddings(spark, sf)
    axes, _ = D.principal_components(df, "embedding", DIMS, 8)
    z = D.project(df, "embedding", axes, "z")
    return N.neighbour_overlap(N.vectors(z, "vec_id", "embedding"), N.vectors(z, "vec_id", "z"), "vec_id")


@query("distance_preservation")
def distance_preservation(spark, sf):
    """On 1000 rows drawn by hash: the measure is one of a sample, and its size is the caller's to name."""
    df = embeddings(spark, sf)
    axes, _ = D.principal_components(df, "embedding", DIMS, 8)
    return C.distance_preservation(D.project(df, "embedding", axes, "z"), "vec_id", "embedding", "z", points=1000)


def _fitted(spark, sf, name, params, label):
    df = lines(spark, sf)
    model = E.fit_family(df, name, NUMBERS, label, params, [Scaler("standard", NUMBERS)], id_col="row_id")
    return E.score(model, df, ["row_id"])


# Small settings: these show each family on the whole table, not its best fit.
_FITS = {
    "fit_random_forest": ("RandomForestClassifier", {"numTrees": 10, "maxDepth": 5}, "flag"),
    "fit_gradient_boosting": ("GradientBoostingClassifier", {"maxIter": 5, "maxDepth": 3}, "returned"),
    "fit_logistic_regression": ("LogisticRegression", {"C": 1.0, "maxIter": 20}, "flag"),
    "fit_linear_svc": ("LinearSVC", {"C": 1.0, "maxIter": 10}, "returned"),
    "fit_gaussian_nb": ("GaussianNB", {}, "flag"),
    "fit_decision_tree": ("DecisionTreeClassifier", {"maxDepth": 5}, "flag"),
    "fit_perceptron": ("MLPClassifier", {"hidden": [8], "maxIter": 20}, "flag"),
    "fit_forest_regressor": ("RandomForestRegressor", {"numTrees": 10, "maxDepth": 5}, "l_extendedprice"),
    "fit_boosting_regressor": ("GradientBoostingRegressor", {"maxIter": 5, "maxDepth": 3}, "l_extendedprice"),
    "fit_linear_regression": ("LinearRegression", {}, "l_extendedprice"),
    "fit_ridge": ("Ridge", {"alpha": 1.0}, "l_extendedprice"),
    "fit_lasso": ("Lasso", {"alpha": 1.0}, "l_extendedprice"),
    "fit_elastic_net": ("ElasticNet", {"alpha": 1.0, "l1Ratio": 0.5}, "l_extendedprice"),
    "fit_linear_svr": ("LinearSVR", {"C": 1.0, "maxIter": 20}, "l_extendedprice"),
    "fit_tree_regressor": ("DecisionTreeRegressor", {"maxDepth": 5}, "l_extendedprice"),
}
for _name, (_family, _params, _label) in _FITS.items():
    query(_name)(lambda spark, sf, a=(_family, _params, _label): _fitted(spark, sf, *a))


@query("fit_boosting_many_classes")
def fit_boosting_many_classes(spark, sf):
    return _fitted(spark, sf, "GradientBoostingClassifier", {"maxIter": 3, "maxDepth": 3}, "flag")


@query("fit_neighbours")
def fit_neighbours(spark, sf):
    """Trained on the labelled documents, all scored: the neighbours of a labelled one include the row itself."""
    df = texts(spark, sf)
    model = E.fit_family(df, "KNeighborsClassifier", MEASURES, "label", {"k": 5, "method": "exact"}, [Scaler("standard", MEASURES)], id_col="doc_id")
    return E.score(model, texts(spark, sf, unlabelled=True), ["doc_id"])


@query(
    "least_squares_fit",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS row_id, round(a + b * l_quantity, 2) AS predicted_value FROM lineitem, f""",
)
def least_squares_fit(spark, sf):
    df = lines(spark, sf)
    model = E.fit_family(df, "LinearRegression", ["l_quantity"], "l_extendedprice")
    return rounded(E.score(model, df, ["row_id"]), 2, "predicted_value")


@query("scored_texts")
def scored_texts(spark, sf):
    """All documents scored by a model of the labelled ones, class numbers back as texts."""
    df = texts(spark, sf)
    model = E.fit_family(df, "LogisticRegression", MEASURES, "label", {"C": 1.0}, [Scaler("standard", MEASURES)])
    return E.score(model, texts(spark, sf, unlabelled=True), ["doc_id"], labels=["poor", "good"])


@query("feature_importance")
def feature_importance(spark, sf):
    df = lines(spark, sf)
    model = E.fit_family(df, "RandomForestRegressor", NUMBERS, "l_extendedprice", {"numTrees": 5, "maxDepth": 5})
    return E.importance_table(spark, "RandomForestRegressor", E.feature_importance(model, NUMBERS))


@query("permutation_importance")
def permutation_importance(spark, sf):
    df = lines(spark, sf).withColumn("label", F.col("l_extendedprice"))
    model = E.fit_family(df, "LinearRegression", NUMBERS, "label")
    return E.permutation_importance(model, df, NUMBERS, "row_id", lambda s: regression_metrics(s).first()["r2"])


@query("feature_contributions")
def feature_contributions(spark, sf):
    """What each feature adds to the price a forest predicts for a line."""
    df = lines(spark, sf)
    model = E.fit_family(df, "RandomForestRegressor", NUMBERS, "l_extendedprice", {"numTrees": 10, "maxDepth": 5})
    return R.feature_contributions(model, df, NUMBERS, ["row_id"])


@query("contributions_add_up", "SELECT count(*) AS n, TRUE AS adds_up FROM lineitem")
def contributions_add_up(spark, sf):
    """Base and contributions against the model's own prediction, for every line."""
    df = lines(spark, sf)
    model = E.fit_family(df, "GradientBoostingRegressor", NUMBERS, "l_extendedprice", {"maxIter": 5, "maxDepth": 4})
    out = R.feature_contributions(model, model.transform(df).drop("features"), NUMBERS, ["prediction"])
    close = F.abs(F.col("total") - F.col("prediction")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return out.agg(F.count("*").alias("n"), F.bool_and(close).alias("adds_up"))


@query(
    "form_bounds",
    union_sql([f"SELECT '{c}' AS feature, min({c}) AS low, max({c}) AS high, round(avg({c}), 6) AS start FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")]),
)
def form_bounds(spark, sf):
    return rounded(E.form_bounds(lines(spark, sf), ["l_quantity", "l_discount", "l_tax"]), 6, "start")


@query("decision_grid")
def decision_grid(spark, sf):
    df = texts(spark, sf)
    model = E.fit_family(df, "DecisionTreeClassifier", ["size", "digits"], "label", {"maxDepth": 4})
    return E.decision_grid(model, df, "size", "digits")


_TEXT_STAGES = [LabelEncoder(["lang"]), Scaler("standard", [*MEASURES, "lang"])]
_TEXT_FEATURES = [*MEASURES, "lang"]


@query("model_search")
def model_search(spark, sf):
    """Trials of three families, preparation inside the folds."""
    result = T.search(
        texts(spark, sf), _TEXT_FEATURES, "label", "doc_id", models=["LogisticRegression", "DecisionTreeClassifier", "GaussianNB"],
        trials=2, folds=3, stages=_TEXT_STAGES, fixed={"LogisticRegression": {"maxIter": 20}, "DecisionTreeClassifier": {"maxDepth": 4}},
    )
    return result.trials


@query("search_by_auc")
def search_by_auc(spark, sf):
    """Guided trials by the area under the curve, hopeless ones given up between the five folds."""
    return T.search(
        texts(spark, sf), _TEXT_FEATURES, "label", "doc_id", models=["DecisionTreeClassifier", "GaussianNB"], metric="auc",
        trials=12, startup=6, stages=_TEXT_STAGES,
    ).trials


@query("search_by_f1")
def search_by_f1(spark, sf):
    return T.search(
        texts(spark, sf), _TEXT_FEATURES, "label", "doc_id", models=["LogisticRegression"], metric="f1", trials=8, startup=6, stages=_TEXT_STAGES,
    ).trials


@query("best_trials")
def best_trials(spark, sf):
    result = T.search(
        lines(spark, sf), NUMBERS, "l_extendedprice", "row_id", task="regression", models=["LinearRegression", "Ridge"],
        trials=2, folds=3, metric="rmse",
    )
    return T.best_trials(result.trials, smaller_is_better=True)


@query(
    "stopping_report",
    """WITH t AS (SELECT CAST(o_orderkey AS INTEGER) AS trial, o_orderpriority AS model, o_totalprice AS score FROM orders),
b AS (SELECT *, max(score) OVER w AS best_so_far, max(score) OVER (PARTITION BY model ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER w AS p FROM t WINDOW w AS (PARTITION BY model ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT trial, model, score, best_so_far, CAST(p - max(CASE WHEN before IS NULL OR score > before THEN p END)
  OVER (PARTITION BY model ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS since_gain FROM b""",
)
def stopping_report(spark, sf):
    """The orders as trials: their price is the score."""
    trials = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("trial"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("score")
    )
    return T.stopping_report(trials)


@query("learning_curve")
def learning_curve(spark, sf):
    return T.learning_curve(
        texts(spark, sf), "DecisionTreeClassifier", MEASURES, "label", "doc_id", {"maxDepth": 4}, shares=(0.25, 0.5, 1.0), folds=2
    )


@query("validation_curve")
def validation_curve(spark, sf):
    return T.validation_curve(texts(spark, sf), "DecisionTreeClassifier", MEASURES, "label", "doc_id", "maxDepth", [2, 6], folds=2)


@query(
    "retrained_model",
    """WITH l AS (SELECT doc_id FROM documents JOIN labels USING (doc_id))
SELECT 'quality' AS name, 'v1' AS version, 'LogisticRegression' AS model_type, NULL AS parent, 1 AS batches, count(*) FILTER (WHERE doc_id % 3 < 2) AS trained_rows FROM l
UNION ALL SELECT 'quality', 'v2', 'LogisticRegression', 'v1', 2, count(*) FROM l""",
)
def retrained_model(spark, sf):
    """A model of two thirds of the rows, retrained when half of these and the others come in: versions and the rows behind them."""
    store = ModelStore(spark, scratch_path(spark, "models"))
    rows = texts(spark, sf)
    for batch in (rows.where("doc_id % 3 < 2"), rows.where("doc_id % 3 > 0")):
        update_model(store, "quality", batch, MEASURES, "label", "doc_id", models=["LogisticRegression"], trials=1, stages=[Scaler("standard", MEASURES)])
    parts = []
    for v in ("v1", "v2"):
        known = store.training_rows("quality", v, "doc_id").agg(F.lit(v).alias("version"), F.count("*").alias("trained_rows"))
        parts.append(known)
    found = store.versions().select("name", "version", "model_type", "parent", F.size("batches").alias("batches"))
    return found.join(parts[0].unionByName(parts[1]), "version")


@query("loaded_model_scores")
def loaded_model_scores(spark, sf):
    """Saved, found by name, loaded, and used for scoring."""
    df = texts(spark, sf)
    model = E.fit_family(df, "LogisticRegression", MEASURES, "label", {"C": 1.0}, [Scaler("standard", MEASURES)])
    store = ModelStore(spark, scratch_path(spark, "models"))
    store.save(model, "quality", "LogisticRegression")
    return classification_metrics(store.load("quality").transform(df))


@query("streamed_scores")
def streamed_scores(spark, sf):
    """A fitted pipeline over a file stream."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    model = E.fit_family(df, "LinearRegression", ["l_quantity", "l_discount"], "label")
    stream = S.read_stream(spark, f"{sf}/lineitem*.parquet", table(spark, sf, "lineitem").schema)
    path = scratch_path(spark, "scores")
    S.append_stream(S.score(stream, model, ["l_orderkey", "l_linenumber"]), path, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(path)


