"""The whole pipeline under stand-in models whose replies SQL can say, and files written and read back.

What the engine's queries check in SQL: how questions are split, gated and routed, how many hits they get, and what
the stub says of the last line of a prompt.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.config import Settings
from hopweave.functions import text
from hopweave.operators import evaluate, fusion, ocr, planning, vector
from hopweave.plans import providers
from hopweave.plans.providers import ModelSpec, embed, generate
from hopweave.plans.qa_queries import _HOPS, _Q
from hopweave.plans.text_queries import _SET, _TOKENS, _WORDS, frequent, read
from hopweave.sources import nodes
from hopweave.storage import checkpointed, fresh
from hopweave.streaming.ingest import append_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return wrap


# The engine.

_PLAN = ("Rate the question", '{"score": {"modality_complexity": 1, "multi_hop_complexity": %d}}')


def _engine(spark, sf_dir, options=(), modality=None, **settings):
    from hopweave.plans.retrieval import Engine

    spec = ModelSpec(options=options)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text", "source", (F.lit("text") if modality is None else modality).alias("modality"), embed(F.col("text"), ModelSpec()).alias("vector"))
    return Engine(spark, d, Settings().updated(**settings), llm=spec, embedder=ModelSpec())


def _asked(spark, sf_dir):
    info = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("images"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), info.alias("information"), F.concat(F.lit("b"), "item_id").alias("id"))


def _shown(answers):
    return answers.select("question_id", "answer", F.array_join("sources", ",").alias("sources"), "n_hits")


_BLANK = "E' \\t\\n\\r'"


def _said(prompt: str) -> str:
    """The stub's reply to a prompt, cleaned: its last line that isn't blank, after the first colon."""
    last = f"list_filter(string_split({prompt}, E'\\n'), lambda l: trim(l, {_BLANK}) <> '')[-1]"
    tail = f"trim(case when contains({last}, ':') then substr({last}, strpos({last}, ':') + 1) else {last} end, {_BLANK})"
    out = f"'stub answer to ' || {tail}"
    for a, b in ((r"\*\*([^\n]*?)\*\*", r"\1"), (r"\*([^\n]*?)\*", r"\1"), (r"(?m)^\s*[-*+]\s+", ""), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim({out})"


_ANSWER = _said("'Question: ' || text")
_NODES = "(select count(*) from documents where trim(text, E' \\t\\n\\r') <> '' {})"


@query(f"select item_id as question_id, 'b' || item_id as id, {_ANSWER} as answer, 'Q1' as sources, 0::bigint as n_hits from benchmark")
def answer_gated(spark, sf_dir):
    """A model that is confident: one hop, no retrieval, and the question's own id carried on."""
    engine = _engine(spark, sf_dir, (("Rate your confidence", "Score: 0.95"), (_PLAN[0], _PLAN[1] % 1)), gated=True)
    got = engine.answer(_asked(spark, sf_dir))
    return _shown(got).join(got.select("question_id", "id"), "question_id").select("question_id", "id", "answer", "sources", "n_hits")


@query(f"select item_id as question_id, {_ANSWER} as answer, 'Q1' as sources, (least(5, {_NODES.format('and doc_id % 2 = 0')}) + least(5, {_NODES.format('and doc_id % 2 = 1')}))::bigint as n_hits from benchmark")
def answer_hybrid(spark, sf_dir):
    """A model that is not confident and chooses hybrid retrieval; odd documents stand in for images."""
    kind = F.when(F.col("doc_id") % 2 == 0, "text").otherwise("image")
    engine = _engine(spark, sf_dir, (("Rate your confidence", "Score: 0.2"), ("Choose the retrieval", "hybrid"), (_PLAN[0], _PLAN[1] % 1)), kind, gated=True)
    return _shown(engine.answer(_asked(spark, sf_dir), "auto"))


_STEPS = 12


@query(
    f"""with recursive s as (select item_id as question_id, 1 as sub_ord, 'stub answer to step 1' as answer from benchmark
    union all select question_id, sub_ord + 1, 'stub answer to step ' || (sub_ord + 1) || ' based on "' || answer || '"' from s where sub_ord < {_STEPS}) select question_id, sub_ord::bigint as sub_ord, answer from s"""
)
def answer_chain(spark, sf_dir):
    """A chain of twelve sub-questions, each about the answer before it."""
    steps = ", ".join(f'"step {i + 1}"' for i in range(_STEPS))
    engine = _engine(spark, sf_dir, ((_PLAN[0], _PLAN[1] % 5), ("Split the question", '{"sub_questions": [%s]}' % steps), ("Improve the sub-questions", "fine")))
    done = engine.answered(_asked(spark, sf_dir), retrieval=False)
    return done.steps.select("question_id", F.col("sub_ord").cast("long").alias("sub_ord"), "answer")


@query(f"select item_id as question_id, {_ANSWER} as answer, 'Q1,Q2' as sources, (2 * least(5, {_NODES.format('')}))::bigint as n_hits from benchmark")
def answer_reviewed(spark, sf_dir):
    """A reviewer who answers in a circle twice: rejected, then kept as there are two sub-questions."""
    loop = '{"refined_subqueries": [{"question": "alpha beta", "type": "Independent", "dependencies": ["sub_2"]}, {"question": "gamma delta [Answer from Q1]", "type": "Bridging", "dependencies": ["sub_1"]}]}'
    engine = _engine(spark, sf_dir, ((_PLAN[0], _PLAN[1] % 3), ("Split the question", '{"subqueries": [{"text": "alpha beta"}, {"text": "gamma delta"}]}'), ("Improve the sub-questions", loop)))
    return _shown(engine.answer(_asked(spark, sf_dir)))


@query("select item_id as question_id, 'from knowledge' as answer from benchmark")
def answer_knowledge(spark, sf_dir):
    """A model that knows nothing from sub-answers or context but something when asked alone."""
    options = ((_PLAN[0], _PLAN[1] % 1), ("Answer briefly from the context", "I don't know"), ("Answer briefly from general knowledge", "from knowledge"))
    return _engine(spark, sf_dir, options).answer(_asked(spark, sf_dir)).select("question_id", "answer")


@query(f"select item_id as question_id, sub_ord, rank from benchmark, (select 1::bigint as sub_ord), (select unnest(range(1, least(5, {_NODES.format('')}) + 1)) as rank)")
def answer_trace(spark, sf_dir):
    """The retrieval trace: every hit of every sub-question, in order."""
    done = _engine(spark, sf_dir, ((_PLAN[0], _PLAN[1] % 1),)).answered(_asked(spark, sf_dir))
    return done.hits.select("question_id", F.col("sub_ord").cast("long").alias("sub_ord"), F.col("rank").cast("long").alias("rank"))


_LETTERS = "list_transform(range(97, 123), lambda c: (length(text) - length(replace(text, chr(c::int), '')))::double)"
_SIMILAR = f"(case when len({_SET.format('question')}) + len({_SET.format('text')}) > 0 then len(list_intersect({_SET.format('question')}, {_SET.format('text')})) / (len({_SET.format('question')}) + len({_SET.format('text')}) - len(list_intersect({_SET.format('question')}, {_SET.format('text')}))) else 0 end)"


def _hits_sql(nodes: str) -> str:
    """What the engine retrieves with letter counts for vectors: the nearest ten, of which the likest five by their words."""
    return f"""(with n as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l from (select doc_id as node_id, text, {_LETTERS} as e from documents where trim(text, E' \\t\\n\\r') <> '' {nodes})),
    q as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l from (select item_id as query_id, text as question, {_LETTERS} as e from benchmark)),
    s as (select query_id, question, node_id, text, round(case when n.l > 0 then list_dot_product(q.e, n.e) / (q.l * n.l) else 0 end, 6) as near from q, n),
    h as (select *, row_number() over (partition by query_id order by near desc, node_id) as r from s qualify r <= 10)
    select query_id, node_id, round({_SIMILAR}, 6) as score, row_number() over (partition by query_id order by round({_SIMILAR}, 6) desc, r) as rank from h qualify rank <= 5)"""


def _letters(spark, sf_dir, modality):
    from hopweave.plans.retrieval import Engine

    spec = ModelSpec(provider="letters", model="letters", dim=26)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text", "source", modality.alias("modality"), embed(F.col("text"), spec).alias("vector")).where("vector is not null")
    return Engine(spark, d, Settings(), embedder=spec)


@query(f"select query_id, rank::bigint as rank, node_id, score from {_hits_sql('')}")
def retrieval_hits(spark, sf_dir):
    """The nodes and scores that the engine retrieves and reranks, by vectors that SQL can say."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    got = _letters(spark, sf_dir, F.lit("text")).retrieve(asked)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", "score")


@query(
    f"""select query_id, row_number() over (partition by query_id order by m, rank)::bigint as position, node_id, case when m = 0 then 'text' else 'image' end as modality
    from (select 0 as m, * from {_hits_sql('and doc_id % 2 = 0')} union all select 1, * from {_hits_sql('and doc_id % 2 = 1')})"""
)
def retrieval_hybrid_hits(spark, sf_dir):
    """The same of both modalities (odd documents stand in for images), texts before images."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    got = _letters(spark, sf_dir, F.when(F.col("doc_id") % 2 == 0, "text").otherwise("image")).retrieve(asked, "hybrid")
    return got.select("query_id", F.col("position").cast("long").alias("position"), "node_id", "modality")


@query("select item_id as query_id, 0.7::double as confidence, true as needed, 'cross_modal' as strategy from benchmark")
def retrieval_judged(spark, sf_dir):
    """Confidence, need and strategy as a model says them."""
    engine = _engine(spark, sf_dir, (("Rate your confidence", "<think>Score: 0.1</think> **Score:** 0.7"), ("Choose the retrieval", "I'd use CROSS_MODAL here")))
    return engine.judged(_asked(spark, sf_dir).select(F.col("question_id").alias("query_id"), "question"))


_SPLIT = "list_filter(regexp_split_to_array(text, '、|,| and '), lambda s: trim(s, E' \\t\\n\\r') <> '')"
_RULED = _HOPS.replace(f"({_Q})", "(select item_id as conv_id, 0 as turn, text as q from benchmark)")


@query(
    f"""with b as (select *, case when hops = 1 then [text] else {_SPLIT} end as subs from benchmark join (select conv_id as item_id, hops from ({_RULED})) using (item_id))
    select item_id as question_id, {_ANSWER} as answer, array_to_string(list_transform(range(1, len(subs) + 1), lambda i: 'Q' || i), ',') as sources,
    (len(list_filter(subs, lambda s: length(trim(s, {_BLANK})) >= 2)) * least(5, {_NODES.format('')}))::bigint as n_hits from b"""
)
def answer_questions(spark, sf_dir):
    """The whole pipeline over the benchmark's questions and all documents, with the offline stand-in models: rules decide where the stub's replies can't be read."""
    return _shown(_engine(spark, sf_dir).answer(_asked(spark, sf_dir)))


# Models.


@query(f"select conv_id, turn, case when text is null or trim(text, {_BLANK}) = '' then '' else {_said('text')} end as said from conversations")
def stub_replies(spark, sf_dir):
    """The stub's reply to every turn, cleaned."""
    from hopweave.functions import parsing

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return generate(c, ModelSpec()).select("conv_id", "turn", parsing.clean_answer(F.col("reply")).alias("said"))


@query("select doc_id, case when trim(text, E' \\t\\n\\r') <> '' then 64 end as dim, case when trim(text, E' \\t\\n\\r') <> '' then true end as unit from documents")
def stub_vectors(spark, sf_dir):
    """Every text's vector has the model's dimension and length one (or zero, if all its words cancel out)."""
    d = read(spark, sf_dir, "documents").select("doc_id", embed(F.col("text"), ModelSpec()).alias("v"))
    n = vector.norm(F.col("v"))
    return d.select("doc_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), F.when(F.col("v").isNotNull(), (F.abs(n - 1) < 1e-5) | (n == 0)).alias("unit"))


@query("select source, count(*) as n, count(*) as cached from (select distinct source from documents) group by source")
def vector_cache(spark, sf_dir):
    """Vectors of distinct texts, embedded once: a second call finds all in the cache."""
    folder, spec = fresh(spark, "cache"), ModelSpec(dim=8)
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("text"))
    providers.cached_embeddings(d, spec, folder)
    providers.cached_embeddings(d, ModelSpec(dim=16), folder)  # another model's vectors stay apart
    again = providers.cached_embeddings(d, spec, folder)
    kept = spark.read.parquet(folder).where("dim = 8").groupBy("text").agg(F.count("*").alias("cached"))
    return again.where("size(vector) = 8").groupBy("text").agg(F.count("*").alias("n")).join(kept, "text").select(F.col("text").alias("source"), "n", "cached")


_JACCARD = "round(case when len(a) + len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0 end, 6)"


@query(
    f"""with t as (select conv_id, turn, list_distinct({_WORDS.format('lower(text)')}) as a, list_distinct({_WORDS.format("lower(first_value(text) over (partition by conv_id order by turn))")}) as b from conversations)
    select conv_id, turn, {_JACCARD} as score from t"""
)
def rerank_model(spark, sf_dir):
    """Scores by a reranking model in calls of four: every turn against its conversation's first."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").withColumn("q", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(providers.rerank_score(F.col("q"), F.col("text"), F.lit(None).cast("string"), ModelSpec()), 6).alias("score"))


# Sources and sinks.

_NODE_SQL = """select 'n' || vec_id as id, case when label % 3 = 0 then 'content ' || vec_id else 'text ' || vec_id end as text, case when label % 4 = 0 then 'image' else 'text' end as modality,
round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))), 4) as first from embeddings where label <> 9"""


def _node_files(spark, sf_dir, folder):
    """Node files of 200 nodes, one JSON list each; nodes of label 9 have no vector, those of label 5 a nested one."""
    e = read(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    item = F.struct(
        F.concat(F.lit("n"), "vec_id").alias("id"), F.when(F.col("label") % 3 != 0, F.concat(F.lit("text "), "vec_id")).alias("text"),
        F.when(F.col("label") % 3 == 0, F.concat(F.lit("content "), "vec_id")).alias("content"), F.when(F.col("label") % 4 == 0, "./data/p.png").alias("image_path"),
        F.when(~F.col("label").isin(5, 9), v).alias("vector"), F.when(F.col("label") == 5, F.array(v)).alias("embedding"),
    )
    files = e.groupBy(F.floor(F.col("vec_id") / 200)).agg(F.to_json(F.collect_list(item)).alias("value")).select("value")
    files.write.option("maxRecordsPerFile", 1).text(folder)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(folder)


@query(_NODE_SQL)
def node_files_scan(spark, sf_dir):
    """Node files written as JSON and scanned: texts by their fallbacks, nested vectors, images, normalised vectors; nodes without a vector and broken files go."""
    folder = fresh(spark, "nodes")
    _node_files(spark, sf_dir, folder)
    n = nodes.scan_nodes(spark, folder, "/mnt", pattern="*.txt")
    return n.select("id", "text", "modality", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("select vec_id::varchar as id, label, len(embedding)::int as dim, round(embedding[1]::double, 6) as first from embeddings")
def node_table_roundtrip(spark, sf_dir):
    """The node table written in two appends and read by its dimension; vectors of another dimension stay apart."""
    path = fresh(spark, "table")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")
    half = F.col("label") % 2 == 0
    nodes.write_nodes(e.where(half), path)
    nodes.write_nodes(e.where(~half), path)
    nodes.write_nodes(e.withColumn("embedding", F.slice("embedding", 1, 32)), path)
    n = nodes.read_nodes(spark, path, 64)
    return n.select("id", "label", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def _as_file(rows, path: str, arrays: tuple) -> None:
    """One JSON file of an object of arrays: rows (name, ord, item: JSON text) by name in the given order, then ord, line by line; such a file has one writer, which holds a batch."""
    order = F.array_position(F.array(*map(F.lit, arrays)), F.col("name"))

    def lines(batches):
        at, some = -1, False
        for pdf in batches:
            out = []
            for name, item in zip(pdf["name"], pdf["item"]):
                k, some = arrays.index(name), True
                if k != at:
                    out += ["]," if at >= 0 else "{"] + [f'"{a}": [],' for a in arrays[at + 1 : k]] + [f'"{name}": [', item]
                    at = k
                else:
                    out.append("," + item)
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]}" if some else "{}"]})

    rows.orderBy(order, "ord").select("name", "item").coalesce(1).mapInPandas(lines, "value string").write.text(path)


@query("select case when item_id % 2 = 0 then 'text' else 'image' end as modality, 'b' || item_id as id, text, case when item_id % 2 = 1 then 'i.png' end as image_path from benchmark")
def legacy_corpora_scan(spark, sf_dir):
    """A legacy corpus file with lists per modality, written and scanned."""
    path = fresh(spark, "legacy")
    b = read(spark, sf_dir, "benchmark")
    even = F.col("item_id") % 2 == 0
    item = lambda key: F.struct(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias(key), F.when(~even, "i.png").alias("image_path"))
    rows = b.select(F.when(even, "corpus").otherwise("image_corpus").alias("name"), F.col("item_id").alias("ord"), F.when(even, F.to_json(item("text"))).otherwise(F.to_json(item("description"))).alias("item"))
    _as_file(rows, path, ("corpus", "image_corpus"))
    return nodes.scan_legacy(spark, path).select("modality", "id", "text", "image_path")


@query("select row_number() over (order by item_id) - 1 as ord, 'u' || item_id as uid, text as query, 'r' || item_id as reference from benchmark")
def samples_scan(spark, sf_dir):
    """Evaluation samples written as one file (what such a file is) and scanned in file order."""
    path = fresh(spark, "samples")
    b = read(spark, sf_dir, "benchmark")
    item = F.struct("item_id", F.concat(F.lit("u"), "item_id").alias("uid"), F.col("text").alias("query"), F.concat(F.lit("r"), "item_id").alias("reference_answer"))
    _as_file(b.select(F.lit("examples").alias("name"), F.col("item_id").alias("ord"), F.to_json(item).alias("item")), path, ("examples",))
    return nodes.scan_samples(spark, path).select("ord", "uid", "query", F.col("reference_answer").alias("reference"))


@query("select doc_id, lang from documents")
def jsonl_roundtrip(spark, sf_dir):
    """Results appended in two runs, the second resuming after the first, and read back."""
    path = fresh(spark, "jsonl")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("uid"), F.lit("").alias("query"))
    nodes.append_jsonl(d.where("doc_id % 3 = 0"), path)
    schema = "doc_id long, lang string, uid string, query string"
    nodes.append_jsonl(nodes.resume(d, nodes.read_results(spark, path, schema)), path)
    return nodes.read_results(spark, path, schema).select("doc_id", "lang")


@query("select query_id, string_agg(rank || ':' || node_id, ' ' order by rank) as top from (select q.vec_id as query_id, c.vec_id as node_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) desc, c.vec_id) as rank from embeddings q, embeddings c where q.vec_id % 50 = 0 qualify rank <= 5) group by query_id")
def similarity_sink(spark, sf_dir):
    """Similarity records before and after (no) reranking, written over an older file and read back."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = vector.top_k(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), 10)
    hits = checkpointed(hits.withColumns({"text": F.concat(F.col("rank"), F.lit(":"), F.col("node_id")), "source": F.lit("")}))
    path = fresh(spark, "records")
    nodes.write_records(spark.range(3), path)
    nodes.write_records(evaluate.similarity_records(hits, vector.truncate(hits, 5)), path)
    entry = "array<struct<score:double,text:string,source:string>>"
    back = spark.read.schema(f"query_id long, retrieval_results {entry}, reranked_results {entry}").json(path)
    return back.where("retrieval_results = reranked_results").select("query_id", F.array_join(F.transform("retrieval_results", lambda r: r["text"]), " ").alias("top"))


@query("select case when doc_id % 2 = 0 then 'text' else 'image' end as modality, doc_id, text from documents")
def corpora_json_sink(spark, sf_dir):
    """Corpora as JSON lines, one folder per modality, read back."""
    path = fresh(spark, "corpora")
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "text").otherwise("image").alias("modality"), F.try_parse_json(F.lit('{"a": 1}')).alias("metadata"))
    nodes.write_corpora_json(d, path)
    return spark.read.schema("doc_id long, text string, metadata string, modality string").json(path).where(F.get_json_object("metadata", "$.a") == "1").select("modality", "doc_id", "text")


@query("select event_id, event_type, value from events")
def stream_append(spark, sf_dir):
    """A folder read as a stream until nothing is new, twice: the second run, under a checkpoint of its own, loses nothing of the first."""
    source, target = fresh(spark, "source"), fresh(spark, "target")
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e.write.parquet(source)
    schema = T.StructType(e.schema.fields)
    for _ in range(2):
        append_rows(spark, source, schema, target, fresh(spark, "stream"), "event_id")
    both = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    return both.groupBy("event_id").agg(F.min("event_type").alias("event_type"), F.min("value").alias("value"), F.count("*").alias("n")).where("n = 2").drop("n")


# Vector stores.

_LONG = "list_transform(embedding, lambda x: x::double * (label + 1))"


@query(f"select vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x ** 2))), 4) as first from (select vec_id, {_LONG} as v from embeddings)")
def vec_add_batch(spark, sf_dir):
    """A batch with vectors off the unit length is normalised as a whole; a batch with one wrong dimension is rejected whole."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    store = vector.add_batch(vector.cleared(e), e, "v", 64)
    store = vector.add_batch(store, e.withColumn("v", F.when(F.col("vec_id") % 100 == 0, F.slice("v", 1, 3)).otherwise(F.col("v"))), "v", 64)
    return store.select("vec_id", F.round(F.col("v")[0], 4).alias("first"))


@query(f"select vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x ** 2))), 4) as first from (select vec_id, {_LONG} as v from embeddings where vec_id % 10 <> 0)")
def vec_add_one(spark, sf_dir):
    """Single nodes: those of another dimension are left out, those off the unit length are normalised."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    odd = e.withColumn("v", F.when(F.col("vec_id") % 10 == 0, F.slice("v", 1, 3)).otherwise(F.col("v")))
    return vector.add_one(vector.cleared(e), odd, "v", 64).select("vec_id", F.round(F.col("v")[0], 4).alias("first"))


# Rules.


@query("select item_id, array_to_string(list_transform(range(1, item_id % 4 + 1), lambda i: 'Q' || i), ',') as sources, 'Error occurred: ' || text as error from benchmark")
def answer_records(spark, sf_dir):
    """Sources by position, and the record of an error."""
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(fusion.sources(F.col("item_id") % 4), ",").alias("sources"), fusion.error_record(F.col("text")).alias("error"))


@query(
    r"""with c as (select item_id, 'What facts are needed to answer: ' || text as a, text as b from benchmark)
    select item_id as question_id, 'Q1' as id, '' as dep, a as question from c where trim(b, E' \t\n\r') <> '' union all
    select item_id, 'Q2', 'Q1', case when regexp_matches(b, '\[Answer from Q\d+\]') then b when ends_with(trim(b, E' \t\n\r'), '?') then regexp_replace(trim(b, E' \t\n\r'), '\?$', '') || ' based on [Answer from Q1]?' else b || ' based on [Answer from Q1]' end from c where trim(b, E' \t\n\r') <> ''
    union all select item_id, 'Q1', '', text from benchmark"""
)
def fixed_chains(spark, sf_dir):
    """The fixed chain where no decomposition could be read, and the direct response: one sub-question that is the question."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    both = planning.fallback_subquestions(q).unionByName(planning.direct_subquestion(q))
    return both.select("question_id", "id", F.array_join("depends_on", ",").alias("dep"), "question")


_SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda s: trim(s, E' \\t\\n\\r')), lambda s: s <> '')"


@query(
    f"""with s as (select doc_id, {_SENT} as s, len({_WORDS.format('text')}) > 10 as coherent from documents)
    select doc_id, i as window_no, array_to_string(s[(i * 5 + 1):(i * 5 + 5)], '. ') as part, coherent from (select *, unnest(range(greatest(ceil(len(s) / 5.0), 1)::bigint)) as i from s)"""
)
def sentence_windows(spark, sf_dir):
    """Windows of five sentences, and whether the whole text is coherent (over ten words)."""
    d = read(spark, sf_dir, "documents").select("doc_id", ocr.coherent(F.col("text")).alias("coherent"), F.posexplode(ocr.sentence_windows(F.col("text"))).alias("window_no", "part"))
    return d.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "part", "coherent")


@query(
    f"""with t as (select doc_id, {_TOKENS} as t from documents), e as (select doc_id, unnest(t) as word, generate_subscripts(t, 1) as pos from t),
    n as (select doc_id, word, count(*) as n, min(pos) as first from e group by all)
    select doc_id, word, n as density from n qualify row_number() over (partition by doc_id order by n desc, first) <= 10"""
)
def keyword_density(spark, sf_dir):
    """The ten most frequent tokens of each document with weight times words."""
    d = read(spark, sf_dir, "documents")
    return frequent(d).select("doc_id", "word", F.round(F.col("n") / F.col("total") * F.col("total")).cast("long").alias("density"))


@query("select doc_id, array_to_string(list_filter(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda w: w not in ('the', 'of', 'et', 'und')), ' ') as tokens from documents")
def own_stopwords(spark, sf_dir):
    """Tokens under a stopword list of one's own."""
    own = ("the", "of", "et", "und", "not-a-token")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text"), stopwords=own), " ").alias("tokens"))
