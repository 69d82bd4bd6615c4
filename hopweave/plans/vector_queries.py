"""Vector queries over embeddings, each with its SQL. Searches ask with every row whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions.text import jaccard
from hopweave.operators import vector
from hopweave.plans.text_queries import _WORDS, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _sides(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))


_PAIRS = """select q.vec_id as query_id, c.vec_id as node_id, c.label, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as score
from embeddings q, embeddings c where q.vec_id % 50 = 0"""
_RANK = "row_number() over (partition by query_id order by score desc, node_id)"


@query(f"select query_id, {_RANK}::bigint as rank, node_id, score from ({_PAIRS}) qualify rank <= 10")
def vec_topk(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    return vector.top_k(q, c, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"select query_id, {_RANK}::bigint as rank, node_id, score from ({_PAIRS}) where score >= 0.3 qualify rank <= 10")
def vec_topk_threshold(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    return vector.top_k(q, c, 10, threshold=0.3).withColumn("rank", F.col("rank").cast("long"))


@query(f"select query_id, {_RANK}::bigint as rank, node_id, score from ({_PAIRS}) qualify rank <= 10")
def vec_topk_tiled(spark, sf_dir):
    """The same search by tiles, as for query sets too large to send to every task."""
    q, c = _sides(spark, sf_dir)
    return vector.top_k(q, c, 10, broadcast_bytes=0).withColumn("rank", F.col("rank").cast("long"))


@query("select vec_id, round(embedding[1]::double / n, 6) as first, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::double / n) ** 2))), 6) as norm from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))) as n from embeddings)")
def vec_normalize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", vector.normalize_corpus(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(vector.norm(F.col("v")), 6).alias("norm"))


@query(
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double * label) as v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x ** 2))) as n from e)
    select vec_id, round(case when n > 1e-8 then v[1] / n else 1 / sqrt(len(v)) end, 6) as as_query, round(v[1] / case when n < 1e-8 then sqrt(len(v)) else n end, 6) + 0 as as_node from n"""
)
def vec_zero_policy(spark, sf_dir):
    """Vectors scaled by their label, so label 0 gives zero vectors: uniform as a query, zero as a node."""
    v = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(vector.normalize_query(F.col("v"))[0], 6).alias("as_query"), (F.round(vector.normalize_corpus(F.col("v"))[0], 6) + F.lit(0.0)).alias("as_node"))


@query(
    """with f as (select label, arg_min(embedding, vec_id) as f from embeddings group by label)
    select vec_id, round(list_cosine_similarity(embedding::double[], f::double[]), 6) as similarity from embeddings join f using (label)"""
)
def vec_cosine(spark, sf_dir):
    """Clamped cosine of every vector with the first of its label."""
    e = read(spark, sf_dir, "embeddings")
    first = vector.first_match(e.select("vec_id", "label", "embedding"), e.select("label", "vec_id", F.col("embedding").alias("f")), "label", "vec_id", ["f"])
    return first.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("f")), 6).alias("similarity"))


@query(
    f"""with h as (select query_id % 7 as question_id, query_id as image_seq, {_RANK} as rank, score, node_id, 'text ' || (node_id // 4) as text from ({_PAIRS}) qualify rank <= 20),
    m as (select question_id, text, round(avg(score), 6) as score, count(*) as n_hits, arg_min(node_id, (image_seq, rank)) as node_id from h group by all)
    select question_id, row_number() over (partition by question_id order by score desc, text)::bigint as rank, text, score, n_hits, node_id from m qualify rank <= 10"""
)
def vec_multi_query_avg(spark, sf_dir):
    """Questions of several vectors: 2k hits each, averaged over the hits of each text."""
    q, c = _sides(spark, sf_dir)
    h = vector.top_k(q, c, 20).select((F.col("query_id") % 7).alias("question_id"), F.col("query_id").alias("image_seq"), "rank", "score", "node_id", F.concat(F.lit("text "), F.floor(F.col("node_id") / 4)).alias("text"))
    return vector.multi_vector_average(h, 10).select("question_id", F.col("rank").cast("long").alias("rank"), "text", "score", "n_hits", "node_id")


@query(
    f"""with h as (select query_id, label, score, {_RANK} as rank from ({_PAIRS}) qualify rank <= 10), v as (select query_id, label, count(*) as votes, round(sum(score), 4) as weight from h group by all)
    select query_id, label, votes from v qualify row_number() over (partition by query_id order by votes desc, weight desc, label) = 1"""
)
def vec_label_knn_vote(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    labels = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    v = vector.top_k(q, c, 10).join(labels, "node_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 4).alias("weight"))
    best = v.groupBy("query_id").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", "weight", -F.col("label"))).alias("b"))
    return best.select("query_id", "b.label", "b.votes")


@query(
    f"""with p as ({_PAIRS}), h as (select query_id, 0 as m, {_RANK} as rank, node_id, score from p where label % 2 = 0 qualify rank <= 5
    union all select query_id, 1, {_RANK} as rank, node_id, score from p where label % 2 = 1 qualify rank <= 5)
    select query_id, row_number() over (partition by query_id order by m, rank)::bigint as position, case m when 0 then 'text' else 'image' end as modality, node_id, score from h"""
)
def hybrid_union(spark, sf_dir):
    """Two retrievers, their modalities simulated by the label's parity; text hits come first whatever the scores."""
    q, _ = _sides(spark, sf_dir)
    e = read(spark, sf_dir, "embeddings")
    side = lambda r: vector.top_k(q, e.where(F.col("label") % 2 == r).select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), 10)
    u = vector.hybrid_union([("text", "local_text", side(0)), ("image", "cross_modal", side(1))], 5)
    return u.select("query_id", F.col("position").cast("long").alias("position"), "modality", "node_id", "score")


_ODD = """with o as (select *, label::int as part, case vec_id % 7 when 3 then list_transform(embedding, lambda x: case when x > 0.1 then 'nan'::double else x::double end)
  when 5 then list_transform(embedding, lambda x: case when x > 0.2 then null else x::double end) when 6 then list_transform(embedding, lambda x: case when x > 0.15 then 'inf'::double else x::double end)
  when 1 then list_transform(embedding[1:32], lambda x: x::double) when 2 then list_transform(embedding, lambda x: 0.0::double) else list_transform(embedding, lambda x: x::double * 1e3) end as v from embeddings),
g as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from o where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
u as (select vec_id, len(v) as d, n, list_transform(v, lambda x: case when n > 1e-8 then x / n else 0 end) as c, list_transform(v, lambda x: case when n > 1e-8 then x / n else 1 / sqrt(len(v)) end) as q from g)"""
_ODD_TOP = _ODD + f""" select query_id, {_RANK}::bigint as rank, node_id, score from (select a.vec_id as query_id, b.vec_id as node_id, round(list_inner_product(a.q, b.c), 6) + 0 as score
from u a join u b on a.d = b.d where a.vec_id % 50 < 7 and a.vec_id % 50 > 0) qualify rank <= 10"""


def _odd(spark, sf_dir, broadcast_bytes):
    x = lambda c: c.cast("double")
    some = lambda least, other: F.transform("embedding", lambda c: F.when(c > least, other).otherwise(x(c)))
    k = F.col("vec_id") % 7
    v = (
        F.when(k == 3, some(0.1, F.lit(float("nan")))).when(k == 5, some(0.2, F.lit(None))).when(k == 6, some(0.15, F.lit(float("inf"))))
        .when(k == 1, F.transform(F.slice("embedding", 1, 32), x)).when(k == 2, F.transform("embedding", lambda c: F.lit(0.0))).otherwise(F.transform("embedding", lambda c: x(c) * 1e3))
    )
    e = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("vector"))
    queries = e.where(F.col("vec_id") % 50 < 7).where(F.col("vec_id") % 50 > 0).select(F.col("vec_id").alias("query_id"), "vector")
    got = vector.top_k(queries, e.select(F.col("vec_id").alias("node_id"), "vector"), 10, broadcast_bytes=broadcast_bytes)
    return got.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.col("score") + F.lit(0.0))


@query(_ODD_TOP)
def vec_topk_odd(spark, sf_dir):
    """Search among vectors with NaN, infinite and null components, zero vectors and other dimensions, on both sides."""
    return _odd(spark, sf_dir, vector.BROADCAST_BYTES)


@query(_ODD_TOP)
def vec_topk_odd_tiled(spark, sf_dir):
    return _odd(spark, sf_dir, 0)


_JACCARD = "round(case when len(a) + len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0 end, 6)"


@query(
    f"""with h as (select query_id, node_id, score, {_RANK} as rank from ({_PAIRS}) qualify rank <= 10),
    t as (select h.*, d.text, list_distinct({_WORDS.format('lower(q.text)')}) as a, list_distinct({_WORDS.format("lower(coalesce(d.text, ''))")}) as b from h left join documents d on d.doc_id = h.node_id left join documents q on q.doc_id = h.query_id),
    s as (select query_id, node_id, rank, round(case when coalesce(text, '') = '' then score else {_JACCARD} end, 6) as score from t)
    select query_id, row_number() over (partition by query_id order by score desc, rank)::bigint as rank, node_id, score from s qualify row_number() over (partition by query_id order by score desc, rank) <= 5"""
)
def lexical_rerank_topk(spark, sf_dir):
    """Ten hits reranked by the lexical stand-in and cut to five; hits without text keep their score."""
    q, c = _sides(spark, sf_dir)
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = vector.top_k(q, c, 10).join(d.withColumnRenamed("doc_id", "node_id"), "node_id", "left").join(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id", "left")
    r = vector.rerank(h, jaccard(F.col("question"), F.col("text")), 5)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", "score")


@query(f"select query_id, {_RANK}::bigint as rank, node_id, score from ({_PAIRS}) qualify rank <= 5")
def rerank_disabled(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    return vector.truncate(vector.top_k(q, c, 10), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    """with f as (select label, min(vec_id) as first_id from embeddings group by label)
    select doc_id, first_id from (select doc_id, doc_id % 12 as label from documents) left join f using (label)"""
)
def vec_first_match(spark, sf_dir):
    """Look-up of the first stored vector with an equal key; keys that are not stored give null."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 12).cast("int").alias("label"))
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("vec_id").alias("first_id"))
    return vector.first_match(d, e, "label", "vec_id", ["first_id"]).select("doc_id", "first_id")


@query("select vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))) - 1) > 1e-4 as off_norm, len(embedding)::int as dim from embeddings where len(embedding) = 64")
def vec_add_check(spark, sf_dir):
    """What adding to a store checks: the dimension, and whether a vector must be normalised."""
    e = vector.of_dimension(read(spark, sf_dir, "embeddings"), "embedding", 64)
    return e.select("vec_id", (F.abs(vector.norm(F.col("embedding")) - 1) > 1e-4).alias("off_norm"), F.size("embedding").alias("dim"))


@query(
    f"""with h as (select query_id, node_id, score, {_RANK} as rank from ({_PAIRS}) qualify rank <= 5)
    select query_id, string_agg(rank || ':' || node_id, ' ' order by rank) as top from h group by query_id"""
)
def similarity_records(spark, sf_dir):
    """Per query, its first five hits as one record."""
    q, c = _sides(spark, sf_dir)
    h = vector.top_k(q, c, 5)
    order = F.array_sort(F.collect_list(F.struct("rank", "node_id")))
    return h.groupBy("query_id").agg(F.array_join(F.transform(order, lambda s: F.concat(s["rank"], F.lit(":"), s["node_id"])), " ").alias("top"))


@query("select query_id, count(*) as n, max(score) as best from (" + _PAIRS + ") where query_id <> node_id group by query_id")
def vec_corpus_stats(spark, sf_dir):
    """Per query, how many nodes of its dimension it was compared with and the best score besides itself."""
    q, c = _sides(spark, sf_dir)
    top = vector.top_k(q, c, 2).where("query_id <> node_id").groupBy("query_id").agg(F.max("score").alias("best"))
    n = c.groupBy(F.size("vector").alias("dim")).agg((F.count("*") - 1).alias("n"))  # one row per dimension
    return q.select("query_id", F.size("vector").alias("dim")).join(n, "dim").join(top, "query_id").select("query_id", "n", "best")
