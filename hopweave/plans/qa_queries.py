"""Planning, decomposition, fusion, evaluation and source queries, each with its SQL.

Conversations stand in for chains of sub-questions (a turn is one), documents for results and samples.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hopweave.functions import parsing, text
from hopweave.operators import evaluate, fusion, planning
from hopweave.plans.text_queries import _EVAL, _WORDS, read
from hopweave.sources import nodes
from hopweave.storage import checkpointed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


@query("select conv_id, turn, least(turn, 2)::int + 1 as modality_complexity from conversations")
def question_modality(spark, sf_dir):
    """A turn counts as having as many images as its number."""
    images = F.when(F.col("turn") > 0, F.array_repeat(F.lit("x.png"), F.col("turn").cast("int")))
    return _turns(spark, sf_dir).select("conv_id", "turn", parsing.modality_complexity(images).cast("int").alias("modality_complexity"))


_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_Q = f"""select conv_id, turn, case turn % 4 when 0 then text
  when 1 then 'Compare the size of ' || coalesce({_W}[1], '') || ' and ' || coalesce({_W}[2], '')
  when 2 then 'Comparison of ' || array_to_string({_W}[1:3], ', ') else array_to_string({_W}[1:2], '、') end as q from conversations"""
_ITEMS = "len(list_filter(string_split({}, '{}'), lambda s: trim(s, ' \t\n\r') <> ''))"


def _questions(spark, sf_dir):
    w = text.words(F.col("text"))
    at = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))
    q = (
        F.when(F.col("turn") % 4 == 0, F.col("text"))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("Compare the size of "), at(1), F.lit(" and "), at(2)))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("Comparison of "), F.array_join(F.slice(w, 1, 3), ", ")))
        .otherwise(F.array_join(F.slice(w, 1, 2), "、"))
    )
    return _turns(spark, sf_dir).select("conv_id", "turn", q.alias("q"))


_HOPS = f"""select conv_id, turn, case when n >= 3 then 4 when n = 2 then 2 else 1 end as hops from (select *, case
  when contains(lower(q), 'compare') or contains(lower(q), 'comparison') then case when contains(part, ' of ') then {_ITEMS.format("replace(string_split(part, ' of ')[-1], ' and ', ',')", ",")} else 0 end
  when contains(q, '、') then {_ITEMS.format("q", "、")} when contains(q, ',') then {_ITEMS.format("q", ",")} else 0 end as n
  from (select *, trim(string_split(lower(q), 'compare the')[-1], E' \\t\\n\\r') as part from ({_Q})))"""


@query(_HOPS)
def parallel_detect(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", parsing.parallel_hops(F.col("q")).alias("hops"))


@query(
    f"""select conv_id, turn, case hops when 1 then 'no_decomposition' else 'parallel_processing' end as route, case hops when 1 then 'direct' else 'parallel' end as kind,
    case hops when 1 then 'simple_direct' else 'parallel' end as planner_route, case hops when 1 then '{parsing.HOP_TYPES[0]}' when 2 then '{parsing.HOP_TYPES[1]}' else '{parsing.HOP_TYPES[3]}' end as name from ({_HOPS})"""
)
def route_strategy(spark, sf_dir):
    h = _questions(spark, sf_dir).withColumn("hops", parsing.parallel_hops(F.col("q")))
    r = parsing.route(F.col("hops").cast("string"))
    return h.select("conv_id", "turn", r.alias("route"), parsing.processing_type(r).alias("kind"), parsing.planner_route(F.col("hops")).alias("planner_route"), parsing.hop_type(F.col("hops")).alias("name"))


@query("select conv_id, turn, case when try_cast(h as int) = 1 then 'no_decomposition' when try_cast(h as int) in (2, 4) then 'parallel_processing' else 'bridge_processing' end as route from (select conv_id, turn, case when turn = 0 then 'abc' else turn::varchar end as h from conversations)")
def route_from_text(spark, sf_dir):
    h = F.when(F.col("turn") == 0, "abc").otherwise(F.col("turn").cast("string"))
    return _turns(spark, sf_dir).select("conv_id", "turn", parsing.route(h).alias("route"))


@query(
    """select conv_id, turn, s as score, coalesce(s, 0) < 0.9 as needed from (select *, case turn % 4 when 0 then least((conv_id % 13) / 10.0, 1.0)::double when 1 then 0.8::double when 2 then null else 0.4::double end as s from conversations)"""
)
def confidence_parse(spark, sf_dir):
    tenths = F.format_string("%.1f", (F.col("conv_id") % 13) / 10)
    k = F.col("turn") % 4
    reply = (
        F.when(k == 0, F.concat(F.lit("**Score:** "), tenths)).when(k == 1, F.lit("<think>Score: 0.1</think>Score: 0.8")).when(k == 2, F.concat(F.lit("Score: -0.2 "), "text")).otherwise(F.lit("score: 0.2 then Score: 0.4"))
    )
    r = _turns(spark, sf_dir).where("true").select("conv_id", "turn", parsing.confidence(reply).alias("score"))
    return r.withColumn("needed", parsing.needs_retrieval(F.col("score")))


@query("select conv_id, turn, case turn % 3 when 0 then 'cross_modal' when 1 then 'hybrid' else 'local_text' end as strategy, case when turn % 3 = 1 then 0.0 else 1.0 end as judged from conversations")
def strategy_decision(spark, sf_dir):
    k = F.col("turn") % 3
    reply = F.when(k == 0, "hybrid or CROSS_MODAL").when(k == 1, "use Hybrid 3").otherwise(F.lit("no idea"))
    judge = F.when(k == 1, "3 of 5").otherwise(F.lit("Rating: 4"))
    return _turns(spark, sf_dir).select("conv_id", "turn", parsing.strategy(reply).alias("strategy"), parsing.judged_accuracy(judge).alias("judged"))


def _raw_subs(spark, sf_dir):
    blank = F.when((F.col("turn") % 5 == 3), F.lit("  ")).otherwise(F.col("text"))
    marked = F.when(F.col("turn") % 5 == 2, F.concat(F.lit("Who [Answer from Q1] won "), F.lit("it?"))).otherwise(blank)
    route = F.when(F.col("conv_id") % 2 == 1, "bridge_processing").otherwise("parallel_processing")
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id"), F.col("turn").alias("ord"), marked.alias("text"), F.lit(None).cast("string").alias("question"), route.alias("routing"))


_SUBS = r"""with r as (select conv_id as question_id, turn as ord, conv_id % 2 = 1 as bridge, case turn % 5 when 3 then '  ' when 2 then 'Who [Answer from Q1] won it?' else text end as q from conversations),
p as (select *, row_number() over (partition by question_id order by ord) as pos from r where trim(q, E' \t\n\r') <> ''),
s as (select question_id, pos::bigint as pos, 'Q' || pos as id, case when bridge and pos > 1 then 'Bridging' else 'Independent' end as type, case when bridge and pos > 1 then 'Q' || (pos - 1) else '' end as dep,
case when bridge and pos > 1 then case when regexp_matches(q, '\[Answer from Q\d+\]') then q
  when ends_with(trim(q, E' \t\n\r'), '?') then regexp_replace(trim(q, E' \t\n\r'), '\?$', '') || ' based on [Answer from Q' || (pos - 1) || ']?' else q || ' based on [Answer from Q' || (pos - 1) || ']' end
  when not bridge and contains(q, '[Answer from') then 'Who won it?' else q end as question from p)"""


@query(_SUBS + " select * from s")
def bridge_chain(spark, sf_dir):
    s = planning.normalise_subquestions(_raw_subs(spark, sf_dir))
    return s.select("question_id", "pos", "id", "type", F.array_join("depends_on", ",").alias("dep"), "question")


@query(
    r"""with w as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as pos, regexp_extract(text, '\S+') as word from conversations),
    l as (select *, lag(word) over (partition by conv_id order by turn) as before from w)
    select conv_id, turn, case when before is null then '[Answer from Q99] ' || text else '"' || before || '" and "' || before || '", see from "' || before || '" but from sub_' || (pos - 1) || '0' end as resolved from l"""
)
def resolve_placeholders(spark, sf_dir):
    """Each turn refers to the one before under both names; the first to one that doesn't exist."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("pos", F.row_number().over(by)).withColumn("word", F.regexp_extract("text", r"(\S+)", 1))
    t = t.withColumn("before", F.lag("word").over(by)).withColumn("p", (F.col("pos") - 1).cast("string"))
    q = F.when(F.col("before").isNull(), F.concat(F.lit("[Answer from Q99] "), "text")).otherwise(
        F.concat(F.lit("[Answer from Q"), "p", F.lit("] and [Answer from sub_"), "p", F.lit("], see from sub_"), "p", F.lit(" but from sub_"), "p", F.lit("0"))
    )
    ids = planning.aliases(F.concat(F.lit("sub_"), "p"))
    known = F.when(F.col("before").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform(ids, lambda i: F.struct(i.alias("k"), F.col("before").alias("v")))))
    return t.select("conv_id", "turn", planning.resolve(q, known, F.array(F.concat(F.lit("sub_"), "p"))).alias("resolved"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by case when turn % 4 = 3 then 0 else turn * 3 % 7 end, turn)::bigint as place from conversations")
def subquestion_order(spark, sf_dir):
    i = F.when(F.col("turn") % 4 == 3, F.lit("x")).otherwise(F.concat(F.lit("sub_"), (F.col("turn") * 3 % 7).cast("string")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(planning.sort_number(i), "turn"))
    return _turns(spark, sf_dir).select("conv_id", "turn", place.cast("long").alias("place"))


def _graph(spark, sf_dir, loops: bool):
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("graph"), "turn", F.concat(F.lit("T"), "turn").alias("id"))
    up = t.where("turn > 0").select("graph", "id", F.concat(F.lit("T"), F.floor(F.col("turn") / 2)).alias("depends_on"))
    if not loops:
        return t.select("graph", "id"), up
    last = t.groupBy("graph").agg(F.max("turn").alias("m")).where("m > 0 and graph % 5 = 0").select("graph", F.lit("T0").alias("id"), F.concat(F.lit("T"), "m").alias("depends_on"))
    return t.select("graph", "id"), up.unionByName(last)


@query(
    """with recursive e as (select conv_id as graph, 'T' || turn as id, 'T' || (turn // 2) as dep from conversations where turn > 0),
    w as (select conv_id as graph, 'T' || turn as id, 0 as level from conversations c where turn = 0 or not exists (from conversations x where x.conv_id = c.conv_id and x.turn = c.turn // 2)
    union all select e.graph, e.id, w.level + 1 from w join e on e.graph = w.graph and e.dep = w.id) select graph, id, max(level) as level from w group by all"""
)
def topo_levels(spark, sf_dir):
    n, e = _graph(spark, sf_dir, loops=False)
    return planning.levels(n, e).withColumn("level", F.col("level").cast("int"))


@query("select conv_id as question_id, case when conv_id % 5 = 0 and max(turn) > 0 then 'rejected' else 'approved' end as status, case when conv_id % 5 = 0 and max(turn) > 0 then 'circular_dependency' end as reason, count(*) as n, not (conv_id % 5 = 0 and max(turn) > 0) or count(*) between 2 and 5 as accepted from conversations group by conv_id")
def cycle_check(spark, sf_dir):
    """Every fifth conversation has its first turn depend on its last."""
    n, e = _graph(spark, sf_dir, loops=True)
    deps = e.groupBy("graph", "id").agg(F.collect_list("depends_on").alias("depends_on"))
    subs = n.join(deps, ["graph", "id"], "left").select(F.col("graph").alias("question_id"), "id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    return planning.accept_after_retries(planning.review(subs))


@query(
    r"""with p as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as pos from conversations)
    select conv_id, turn, case when pos > 1 and turn % 2 = 1 and not regexp_matches(text, '\[Answer from [^\]]+\]') then 'Based on [Answer from Q' || (pos - 1) || '], ' || text else text end as question from p"""
)
def review_restore(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = _turns(spark, sf_dir).withColumn("pos", pos)
    kind = F.when(F.col("turn") % 2 == 1, "Bridge").otherwise("Independent")
    original = F.when(F.col("turn") % 2 == 1, F.array(F.concat(F.lit("sub_"), F.col("pos") - 1)))
    return t.select("conv_id", "turn", planning.restore_placeholder(F.col("text"), F.col("pos"), kind, F.array().cast("array<string>"), original).alias("question"))


@query("select conv_id as question_id, 'sub_' || turn as sub_id, text as question from conversations where turn % 3 <> 0 union all select conv_id, 'subq_1', 'whole ' || conv_id from conversations group by conv_id having max(turn % 3) = 0")
def blank_subquestions(spark, sf_dir):
    """Turns divisible by three are blank; a conversation without others falls back to its own question."""
    t = _turns(spark, sf_dir)
    subs = t.select(F.col("conv_id").alias("question_id"), F.concat(F.lit("sub_"), "turn").alias("sub_id"), F.lit("").alias("query"), F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" ").alias("question"))
    asked = t.select(F.col("conv_id").alias("question_id")).distinct().withColumn("question", F.concat(F.lit("whole "), "question_id"))
    return planning.nonblank_or_question(subs, asked)


def _hits(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3 + 1).alias("sub_ord"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    h = e.join(d, "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("label", "sub_ord").orderBy("vec_id")))
    return h.select(F.col("label").alias("question_id"), "sub_ord", "rank", "text", "source", ((F.col("vec_id") % 100) / 100).alias("score"), F.col("vec_id").alias("node_id"))


_HITS = """with h as (select label as question_id, vec_id % 3 + 1 as sub_ord, text, source, (vec_id % 100) / 100 as score, vec_id as node_id, row_number() over (partition by label, vec_id % 3 order by vec_id) as rank from embeddings join documents on doc_id = vec_id)"""


@query(
    _HITS
    + """, u as (select *, row_number() over (partition by question_id, sub_ord order by rank) as j from h where text <> '')
    select question_id, count(*) as n_hits, string_agg('[Q' || sub_ord || '_R' || j || '] (score ' || printf('%.2f', score) || ') ' || text || case when source <> '' then ' | source: ' || source else '' end, E'\\n' order by sub_ord, j) as context from u group by question_id"""
)
def fusion_context(spark, sf_dir):
    return fusion.context(_hits(spark, sf_dir))


@query(_HITS + " select question_id, text, sub_ord, rank::int as rank, source, score, node_id from h qualify row_number() over (partition by question_id, text order by sub_ord, rank) = 1")
def fusion_distinct_hits(spark, sf_dir):
    return fusion.distinct_hits(_hits(spark, sf_dir)).select("question_id", "text", "sub_ord", "rank", "source", "score", "node_id")


@query("select conv_id as question_id, trim(string_agg(text, ' ' order by turn), E' \\t\\n\\r') as information, count(*) as n, array_to_string(list_transform(range(1, count(*) + 1), lambda i: 'Q' || i), ',') as sources from conversations group by conv_id")
def fusion_union(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sub_ord"), F.col("text").alias("information"))
    n = t.groupBy("question_id").agg(F.count("*").alias("n"))
    return fusion.joined_texts(t).join(n, "question_id").withColumn("sources", F.array_join(fusion.sources(F.col("n")), ","))


@query("select conv_id, turn, case when turn % 2 = 0 then 'data:image/png;base64,' || conv_id end as image, case when turn % 2 = 0 then 2 else 1 end as n_images from conversations")
def image_union(spark, sf_dir):
    """Distinct images in order of appearance, and the first that is inline."""
    inline = F.concat(F.lit("data:image/png;base64,"), "conv_id")
    a = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a.png"), inline)).otherwise(F.array(F.lit("a.png")))
    i = fusion.distinct_images(F.array(a, F.array(F.lit("a.png"))))
    return _turns(spark, sf_dir).select("conv_id", "turn", fusion.data_image(i).alias("image"), F.size(i).alias("n_images"))


@query(f"select conv_id as question_id, turn + 1 as sub_ord, text as answer from conversations where turn % 2 = 1 union all select conv_id, 1, '{fusion.NO_RESULTS}' from conversations group by conv_id having max(turn % 2) = 0")
def fusion_valid(spark, sf_dir):
    """Even turns failed; a conversation of failures gets one placeholder row."""
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("sub_ord"), F.col("text").alias("answer"), F.when(F.col("turn") % 2 == 0, "failed").alias("error"))
    return fusion.valid_subresults(t, t.select("question_id").distinct())


@query(r"select conv_id, turn, case turn % 3 when 0 then trim(regexp_replace(text, '\s+', ' ', 'g')) when 1 then 'a b' else '' end as answer from conversations")
def answer_fallback(spark, sf_dir):
    k = F.col("turn") % 3
    model = F.when(k == 0, F.col("text")).otherwise("")
    subs = F.when(k == 1, F.array(F.lit("a"), F.lit(""), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return _turns(spark, sf_dir).select("conv_id", "turn", fusion.final_answer(model, subs, F.lit("Not mentioned")).alias("answer"))


@query("select conv_id as question_id, 'sub_' || turn as id, 'Sub-question sub_' || turn as question, text as answer from conversations")
def fusion_legacy(spark, sf_dir):
    m = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("question_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("sub_"), "turn"), "text"))).alias("answers"))
    return fusion.legacy(m)


@query(f"""with f as (select lang, arg_min(text, doc_id) as truth from documents group by lang)
select doc_id, ({_WORDS.format(_EVAL)} = {_WORDS.format(_EVAL.replace('text', 'truth'))})::int::double as exact_match from documents join f using (lang)""")
def em_score(spark, sf_dir):
    """Exact match of every text with the first of its language."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", evaluate.normal_digest(F.col("text")).alias("digest"))
    d = checkpointed(d)  # every text is normalised once, and only digests are joined
    truth = d.where("doc_id is not null").groupBy("lang").agg(F.min_by("digest", "doc_id").alias("truth"))
    return d.join(truth, "lang").select("doc_id", (F.col("digest") == F.col("truth")).cast("double").alias("exact_match"))


def _results(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5
    kind = F.element_at(F.array(F.lit("text"), F.lit("Table"), F.lit("chart_text"), F.lit("2d_layout"), F.lit(None)), number + 1)
    return d.select("doc_id", F.col("text").alias("response"), F.col("quality").cast("double").alias("exact_match"), F.col("toxic").cast("double").alias("accuracy"), F.when(F.col("lang") == "en", "single_hop").when(F.col("lang") == "fr", "Multi_Hop").alias("query_type"), kind.alias("source_type"))


@query("select count(*) as total_queries, count_if(text <> '') as successful_queries, round(count_if(text <> '') / count(*), 6) as success_rate, count(quality) as valid_eval_items, round(coalesce(avg(quality), 0), 6) as exact_match, round(coalesce(avg(toxic), 0), 6) as accuracy from documents left join labels using (doc_id)")
def eval_overall(spark, sf_dir):
    return evaluate.overall(_results(spark, sf_dir))


_CATS = """with r as (select coalesce(quality, 0)::double as em, coalesce(toxic, 0)::double as acc, case lang when 'en' then 'single_hop' when 'fr' then 'multi_hop' else 'single_hop' end as q,
case regexp_extract(source, '\\d+')::int % 5 when 0 then 'text' when 1 then 'table' when 2 then 'chart_text' when 3 then '2d_layout' else 'text' end as s from documents left join labels using (doc_id)),
c(pos, category, field, key) as (values (1, 'Single-hop', 'q', 'single_hop'), (2, 'Multi-hop', 'q', 'multi_hop'), (3, 'Text', 's', 'text'), (4, 'Table', 's', 'table'), (5, 'Chart', 's', 'chart'), (6, 'Layout', 's', '2d_layout'))"""


@query(_CATS + " select category, count(em) as n, round(coalesce(avg(acc), 0), 6) as accuracy, round(coalesce(avg(em), 0), 6) as exact_match from c left join r on contains(case field when 'q' then q else s end, key) group by category")
def eval_by_category(spark, sf_dir):
    return evaluate.by_category(_results(spark, sf_dir))


@query(_CATS + " select pos::bigint as position, category, printf('%.2f', round(coalesce(avg(acc), 0), 6) * 100) as accuracy, printf('%.2f', round(coalesce(avg(em), 0), 6) * 100) as exact_match from c left join r on contains(case field when 'q' then q else s end, key) group by pos, category")
def eval_table(spark, sf_dir):
    return evaluate.percent_table(evaluate.by_category(_results(spark, sf_dir)))


@query("select doc_id, lang from documents where not exists (from labels l where l.doc_id = documents.doc_id)")
def resume_anti_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("uid"), F.lit("").alias("query"))
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("uid"), F.lit("").alias("query"))
    return nodes.resume(d, done).select("doc_id", "lang")


@query("select text, min(doc_id) as doc_id, count(*) as copies from documents group by text")
def exact_dedup_first(spark, sf_dir):
    """The first of each text. Only digests and ids are shuffled; texts are joined back for the firsts alone."""
    d = read(spark, sf_dir, "documents")
    first = d.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return d.select("doc_id", "text").join(first.select("doc_id", "copies"), "doc_id")


@query("select doc_id, case doc_id % 3 when 0 then source when 1 then lang else 'fallback' end as truth from documents")
def ground_truth_chain(spark, sf_dir):
    k = F.col("doc_id") % 3
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", evaluate.ground_truth(F.when(k == 0, F.col("source")).otherwise(""), F.when(k == 1, F.col("lang")), F.lit("fallback")).alias("truth"))


@query("select page_id, length(trim(case page_id % 3 when 0 then ' x ' when 1 then url else '' end)) >= 2 as valid from pages")
def query_validity(spark, sf_dir):
    k = F.col("page_id") % 3
    return read(spark, sf_dir, "pages").select("page_id", text.valid_query(F.when(k == 0, " x ").when(k == 1, F.col("url")).otherwise("")).alias("valid"))


@query("select item_id, case when item_id % 2 = 0 then text else 'old ' || text end as question, case when item_id % 2 = 0 then '' else 'i.png' end as images from benchmark")
def question_formats(spark, sf_dir):
    """Questions of the new and the old form in one shape."""
    k = F.col("item_id") % 2 == 0
    b = read(spark, sf_dir, "benchmark").select("item_id", F.when(k, F.col("text")).alias("question"), F.when(~k, F.concat(F.lit("old "), "text")).alias("query"), F.when(~k, "i.png").alias("image_path"))
    return nodes.normalise_questions(b).select("item_id", "question", F.array_join("information.images", ",").alias("images"))


@query("select doc_id, case when doc_id % 2 = 0 and doc_id % 3 = 0 then 'answer,score' when doc_id % 2 = 0 then 'answer' when doc_id % 3 = 0 then 'score' end as missing from documents where doc_id % 2 = 0 or doc_id % 3 = 0")
def required_fields(spark, sf_dir):
    """Rows that lack required fields, with the names of those."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("answer"), F.when(F.col("doc_id") % 3 != 0, F.lit(1)).alias("score"))
    return nodes.rejects(d, ["answer", "score"])[1].select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("select 'doc' || doc_id as stem from documents where not exists (from labels l where l.doc_id = documents.doc_id)")
def ingest_pending(spark, sf_dir):
    """Inputs whose output is absent, by file stem."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("/in/doc"), "doc_id", F.lit(".json")).alias("path"))
    done = read(spark, sf_dir, "labels").select(F.concat(F.lit("/out/doc"), "doc_id", F.lit(".node")).alias("path"))
    return nodes.pending(d, done).select("stem")


# Beyond the retrieval engine: plain relational and event-time queries, which Spark has built in.


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def x_pricing_summary(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query("select event_type, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def x_event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")


@query("select n_name, r_name, count(*) as customers, round(avg(c_acctbal), 4) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def x_region_rollup(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance")).select("n_name", "r_name", "customers", "balance")


def _json(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    f"""select conv_id, turn, case when turn % 3 = 2 then least(turn, 2)::int + 1 else 2 end as modality, case when turn % 3 = 2 then hops else 3 end as hops, (turn % 2 = 0)::int as need, case when turn % 2 = 0 then 'Multi_Agent' else 'Direct_Gen' end as routing from ({_HOPS})"""
)
def plan_replies(spark, sf_dir):
    """Planner replies that are JSON, fenced with single quotes, or unreadable (then the rules decide)."""
    from hopweave.operators import replies

    k = F.col("turn") % 3
    good = F.lit('{"score": {"modality_complexity": 2, "multi_hop_complexity": "3"}}')
    reply = F.when(k == 0, good).when(k == 1, F.lit("```json\n{'modality_complexity': 2, 'multi_hop_complexity': 3,}\n```")).otherwise(F.lit("no plan"))
    images = F.when(F.col("turn") > 0, F.array_repeat(F.lit("x.png"), F.col("turn").cast("int")))
    s = replies.planned(reply, F.col("q"), images, F.when(F.col("turn") % 2 == 0, 0.2).otherwise(0.95))
    return _questions(spark, sf_dir).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.col("s.modality_complexity").cast("int").alias("modality"), F.col("s.multi_hop_complexity").alias("hops"), F.col("s.retrieval_necessity").alias("need"), F.col("s.routing_decision").alias("routing"))


@query("select conv_id as question_id, 1::bigint as pos, 'first ' || conv_id as question from conversations group by conv_id union all select conv_id, 2, 'second based on [Answer from Q1]' from conversations group by conv_id")
def decompose_replies(spark, sf_dir):
    """Decomposer replies under different keys, as objects or strings."""
    from hopweave.operators import replies

    c = _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id")).distinct()
    id_ = F.col("question_id").cast("string")
    reply = F.when(F.col("question_id") % 2 == 0, _json('{"sub_questions": [], "questions": ["first ', id_, '", "", "second"]}')).otherwise(_json('note {"subqueries": [{"text": "first ', id_, '"}, {"question": "second"}]} end'))
    return planning.normalise_subquestions(replies.decomposed(c.select("question_id", reply.alias("reply"), F.lit("bridge_processing").alias("routing")))).select("question_id", "pos", "question")


@query("select conv_id as question_id, 1::bigint as pos, case when conv_id % 2 = 0 then 'new' else 'old 1' end as question from conversations group by conv_id union all select conv_id, 2, case when conv_id % 2 = 0 then 'Based on [Answer from Q1], newer' else 'old 2' end from conversations group by conv_id")
def review_replies(spark, sf_dir):
    """Reviews that refine a chain and lose its reference, or can't be read."""
    from hopweave.operators import replies

    c = _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id")).distinct()
    raw = c.select("question_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("pos")).select("question_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("old "), "pos").alias("question"), F.when(F.col("pos") == 2, "Bridging").otherwise("Independent").alias("type"), F.when(F.col("pos") == 2, F.array(F.lit("sub_1"))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    reply = F.when(F.col("question_id") % 2 == 0, '{"refined_subqueries": [{"question": "new"}, {"question": "newer"}]}').otherwise("looks fine")
    return replies.refined(raw, c.select("question_id", reply.alias("reply"))).select("question_id", "pos", "question")


@query("select doc_id, case doc_id % 3 when 0 then 'f' || doc_id when 1 then 'i' || doc_id else source end as source, case doc_id % 3 when 0 then text when 1 then 'd' else 'Source: ' || source end as shown, case doc_id % 3 when 2 then '' else 'a' end as kept from documents")
def hit_projection(spark, sf_dir):
    """Source and text of hits by their chains of fallbacks, and metadata without vectors."""
    from hopweave.operators import replies

    k, d = F.col("doc_id") % 3, read(spark, sf_dir, "documents")
    raw = F.when(k == 0, _json('{"file_name": "f', F.col("doc_id").cast("string"), '", "a": 1, "vector": [1]}')).when(k == 1, _json('{"id": "i', F.col("doc_id").cast("string"), '", "description": "d", "a": 2}')).otherwise("{}")
    m = d.withColumn("m", F.try_parse_json(raw)).withColumn("t", F.when(k == 0, F.col("text")).otherwise(""))
    keys = F.array_join(F.filter(F.map_keys(replies.without_vectors(F.col("m"))), lambda x: x.isin("a", "vector")), ",")
    return m.select("doc_id", replies.hit_source(F.col("m"), F.col("source")).alias("source"), replies.hit_text(F.col("t"), F.col("m"), F.col("source")).alias("shown"), keys.alias("kept"))
