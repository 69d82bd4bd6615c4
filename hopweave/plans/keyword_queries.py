"""Keywords by tf-idf and TextRank, and segmentation by a dictionary, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions import segment, text
from hopweave.operators import keywords
from hopweave.plans.text_queries import _TOKENS, read
from hopweave.storage import checkpointed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return wrap


def _words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))


@query(
    f"""with t as (select doc_id, {_TOKENS} as t from documents), e as (select doc_id, len(t) as total, unnest(t) as word from t),
    n as (select doc_id, word, count(*) as n, any_value(total) as total from e group by all), d as (select word, count(*) as df from n group by word),
    w as (select doc_id, word, round(n / total * (ln((1.0 + (select count(*) from documents)) / (1 + df)) + 1), 6) as weight from n join d using (word))
    select doc_id, row_number() over (partition by doc_id order by weight desc, word)::bigint as rank, word, weight from w qualify rank <= 10"""
)
def kw_tf_idf(spark, sf_dir):
    """The ten words of each document that tell it from all others."""
    return keywords.tf_idf(_words(spark, sf_dir))


def _rounds(n: int) -> str:
    return ", ".join(
        f"r{i} as materialized (select v.doc_id, v.word, 0.15 + 0.85 * coalesce(s.s, 0) as r from v left join (select g.doc_id, g.b as word, sum(g.w * r.r / o.o) as s "
        f"from g join r{i - 1} r on r.doc_id = g.doc_id and r.word = g.a join o on o.doc_id = g.doc_id and o.a = g.a group by all) s using (doc_id, word))"
        for i in range(1, n + 1)
    )


@query(
    f"""with t as (select doc_id, {_TOKENS} as t from documents), e as (select doc_id, unnest(t) as word, generate_subscripts(t, 1) as pos from t),
    v as materialized (select distinct doc_id, word from e), p as (select x.doc_id, x.word as a, y.word as b from e x join e y on x.doc_id = y.doc_id and y.pos > x.pos and y.pos < x.pos + 5 and x.word <> y.word),
    g as materialized (select doc_id, a, b, count(*) as w from (select * from p union all select doc_id, b, a from p) group by all), o as materialized (select doc_id, a, sum(w) as o from g group by all),
    r0 as materialized (select doc_id, word, 1 / count(*) over (partition by doc_id) as r from v), {_rounds(10)}, f as (select doc_id, word, round(r, 5) as weight from r10)
    select doc_id, row_number() over (partition by doc_id order by weight desc, word)::bigint as rank, word, weight from f qualify rank <= 10"""
)
def kw_text_rank(spark, sf_dir):
    """The ten words of each document of the highest rank after ten rounds on its graph of words less than five apart."""
    return keywords.text_rank(_words(spark, sf_dir))


_BARE = r"regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')"


@query(f"select doc_id, {_BARE} as rejoined, true as known from documents where {_BARE} <> ''")
def segment_words(spark, sf_dir):
    """Texts without any space, segmented by the corpus's own words and counts: every part of two and more characters is such a word, and nothing is lost."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.split("text", r"[^\p{L}\p{N}]+")
    dictionary = checkpointed(d.select(F.explode(pieces).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "dictionary")
    bare = d.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", "").alias("bare")).where("bare <> ''")
    found = checkpointed(segment.segmented(bare, dictionary, "bare", runs=r"[^\s]+", others="", limited=False).select("doc_id", "words"), "segmented")
    long = found.select("doc_id", F.explode(F.array_distinct(F.filter("words", lambda w: F.length(w) > 1))).alias("word"))
    strange = checkpointed(long.select("word").distinct().join(dictionary, "word", "left_anti"), "strange")
    whole = F.array_join("words", "").alias("rejoined")
    if strange.isEmpty():
        return found.select("doc_id", whole, F.lit(True).alias("known"))
    unknown = long.join(strange, "word").select("doc_id").distinct().withColumn("known", F.lit(False))
    return found.select("doc_id", whole).join(unknown, "doc_id", "left").select("doc_id", "rejoined", F.coalesce("known", F.lit(True)).alias("known"))
