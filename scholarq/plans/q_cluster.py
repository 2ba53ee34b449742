"""TF-IDF and clustering queries (C6) over the documents corpus.

Paper text = title + ' ' + abstract with title = the document's source
label and abstract = its text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.functions.stopwords import ENGLISH_STOP_WORDS
from scholarq.functions.text import WORD2
from scholarq.operators import clustering as C
from scholarq.operators import tfidf as T
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import table, v_arxiv, v_doc_text, v_papers


def _papers(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"),
                                                F.col("source").alias("title"), F.col("text").alias("abstract"))


def _docs(spark, d):
    p = _papers(spark, d)
    return p.select("paper_id", T.assemble_text(F.col("title"), F.col("abstract")).alias("text"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(ENGLISH_STOP_WORDS))) + "]"
_TFIDF_CTES = {
    "toks": f"""SELECT doc_id, list_filter(regexp_extract_all(lower(COALESCE(source, '') || ' ' || COALESCE(text, '')),
                                                         '{WORD2}'), lambda t: NOT list_contains({_STOP}, t)) AS k
               FROM documents""",
    "terms": """SELECT doc_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS term
               FROM toks""",
    "dtc": "SELECT doc_id, term, COUNT(*) AS tf FROM terms GROUP BY doc_id, term",
    "vocab": f"""SELECT term, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS cf FROM dtc GROUP BY term
                ORDER BY cf DESC, term LIMIT {T.MAX_FEATURES}""",
    "ndocs": "SELECT COUNT(*) AS n FROM documents",
    "w": """SELECT d.doc_id, d.term, d.tf * (ln((1 + ndocs.n) / (1 + v.df)) + 1) AS w
            FROM dtc d JOIN vocab v ON v.term = d.term CROSS JOIN ndocs""",
    "wn": "SELECT doc_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w",
}


@query("tfidf_weights", with_views("SELECT doc_id AS paper_id, term, round(weight, 6) AS weight FROM wn",
                                   extra=_TFIDF_CTES), "CL1 CL2 CL4")
def tfidf_weights(spark, d):
    w, _ = T.tfidf(_docs(spark, d), "paper_id", "text")
    return w.select("paper_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_vocab", with_views(
    """SELECT v.term, v.df, v.cf, round(ln((1 + ndocs.n) / (1 + v.df)) + 1, 9) AS idf
       FROM vocab v CROSS JOIN ndocs""", extra=_TFIDF_CTES), "CL3")
def tfidf_vocab(spark, d):
    _, v = T.tfidf(_docs(spark, d), "paper_id", "text")
    return v.select("term", "df", "cf", F.round("idf", 9).alias("idf"))


@query("cluster_terms_given_labels", with_views(
    f"""SELECT cluster, CAST(rank AS BIGINT) AS rank, term, round(weight, 6) AS weight FROM (
          SELECT c.cluster, c.term, c.s / z.n AS weight,
                 row_number() OVER (PARTITION BY c.cluster ORDER BY c.s / z.n DESC, c.term) AS rank
          FROM (SELECT l.source AS cluster, wn.term, SUM(wn.weight) AS s
                FROM wn JOIN documents l ON l.doc_id = wn.doc_id GROUP BY l.source, wn.term) c
          JOIN (SELECT source AS cluster, COUNT(*) AS n FROM documents GROUP BY source) z ON z.cluster = c.cluster)
        WHERE rank <= {T.TOP_TERMS}""", extra=_TFIDF_CTES), "AGG14 CL7")
def cluster_terms_given_labels(spark, d):
    docs = _docs(spark, d)
    w, _ = T.tfidf(docs, "paper_id", "text")
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("cluster"))
    return T.cluster_terms(w, labels, "paper_id", "cluster").withColumn("weight", F.round("weight", 6))


@query("cluster_union_input", with_views(
    """SELECT CAST(p.paper_id AS VARCHAR) AS paper_id, paper_name AS title, coalesce(d.text, '') AS abstract
       FROM v_papers p LEFT JOIN documents d ON d.doc_id = p.paper_id
       UNION ALL SELECT arxiv_id, title, COALESCE(abstract, '') FROM v_arxiv""", "v_papers", "v_arxiv"), "SET3")
def cluster_union_input(spark, d):
    return C.union_for_clustering(v_papers(spark, d), v_doc_text(spark, d), v_arxiv(spark, d))


def _fitted(spark, d, what: str) -> C.Clustering:
    papers = _papers(spark, d) if what == "documents" else cluster_union_input(spark, d)
    return C.fit_clusters(papers, "paper_id", "title", "abstract", k=3)


@query("kmeans_members", "SELECT doc_id AS paper_id, source AS title, true AS in_cluster, true AS placed FROM documents",
       "CL5 CL8 (every paper once, in one of k clusters, with coordinates)")
def kmeans_members(spark, d):
    return _fitted(spark, d, "documents").members.select(
        "paper_id", "title", F.col("cluster").between(0, 2).alias("in_cluster"),
        (F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")).alias("placed"))


@query("kmeans_cluster_terms", f"SELECT CAST(unnest(range(3)) AS INTEGER) AS cluster, {T.TOP_TERMS}::BIGINT AS n_terms, true AS ranked",
       "CL7 CL8 (top terms of each cluster, by falling weight)")
def kmeans_cluster_terms(spark, d):
    by_rank = F.array_sort(F.collect_list(F.struct("rank", (-F.col("weight")).alias("w"))))
    by_weight = F.array_sort(F.collect_list((-F.col("weight")).alias("w")))
    return _fitted(spark, d, "documents").terms.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_terms"), (F.transform(by_rank, lambda x: x["w"]) == by_weight).alias("ranked"))


@query("kmeans_member_places", None, "CL5 CL8 (cluster and coordinates of every paper)")
def kmeans_member_places(spark, d):
    return _fitted(spark, d, "documents").members.select("paper_id", "title", "cluster", "x", "y")


@query("kmeans_term_weights", None, "CL7 CL8 (ranked terms of each cluster with their weights)")
def kmeans_term_weights(spark, d):
    return _fitted(spark, d, "documents").terms.select("cluster", "rank", "term", "weight")


@query("cluster_lists", "SELECT count(*) AS n_papers, 3::BIGINT AS n_clusters, 0::BIGINT AS wrong_ranks FROM documents",
       "AGG13 (ranked rows of each cluster: sizes sum up, ranks are gapless)")
def cluster_lists(spark, d):
    members = _fitted(spark, d, "documents").members
    listed = C.ranked_members(members).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    sizes = C.cluster_sizes(members)
    return listed.join(sizes, "cluster").agg(
        F.sum("n_papers").alias("n_papers"), F.count(F.lit(1)).alias("n_clusters"),
        F.count_if((F.col("n") != F.col("n_papers")) | (F.col("ranks") != F.col("n")) | (F.col("low") != 1)
                   | (F.col("high") != F.col("n"))).alias("wrong_ranks"))


def _invariants(fit: C.Clustering):
    """What holds of any fit: each paper is nearest to its own centre, coordinates
    are centred, uncorrelated and ordered by variance, components orthonormal."""
    near = C.squared_distances(fit.vectors, "paper_id", fit.centres).join(fit.members, "paper_id")
    wrong = F.get("dist", F.col("cluster")) > F.array_min("dist") + 1e-9
    p, q = fit.components
    dot = lambda a, b: abs(round(sum(x * y for x, y in zip(a, b, strict=True)), 6))
    return near.agg(
        F.count(F.lit(1)).alias("n_papers"), F.count_if(wrong).alias("misassigned"),
        F.abs(F.round(F.avg("x"), 6)).alias("mean_x"), F.abs(F.round(F.avg("y"), 6)).alias("mean_y"),
        F.abs(F.round(F.covar_pop("x", "y"), 6)).alias("covariance"),
        (F.var_pop("x") >= F.var_pop("y")).alias("ordered"),
        F.lit(dot(p, q)).alias("components_dot"), F.lit(dot(p, p) == 1.0 and dot(q, q) == 1.0).alias("unit_components"))


_INVARIANTS = """SELECT {n} AS n_papers, 0::BIGINT AS misassigned, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y,
                 0.0::DOUBLE AS covariance, true AS ordered, 0.0::DOUBLE AS components_dot, true AS unit_components"""


@query("kmeans_invariants", _INVARIANTS.format(n="(SELECT count(*) FROM documents)"), "CL5 CL6 CL8")
def kmeans_invariants(spark, d):
    return _invariants(_fitted(spark, d, "documents"))


@query("cluster_union_invariants", _INVARIANTS.format(n="(SELECT 2 * count(*) FROM orders)"),
       "SET3 CL5 CL6 CL8 (local and remote papers clustered together)")
def cluster_union_invariants(spark, d):
    return _invariants(_fitted(spark, d, "union"))
