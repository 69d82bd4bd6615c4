"""Text queries over documents, pages and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.functions import parsing, text
from hopweave.operators import ocr

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_TOKENS = f"list_filter(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda w: not list_contains({_STOP}, w))"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda s: trim(s, ' \t\n\r')), lambda s: s <> '')"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_PUNCT = r"[!-/:-@\[-`{-~]"


@query(rf"""select doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), 'https?://\S+|www\.\S+', '', 'g')), '{_PUNCT}', '', 'g')) as cleaned from documents""")
def txt_clean(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"select doc_id, array_to_string({_TOKENS}, ' ') as tokens, len({_TOKENS})::bigint as n_tokens from documents")
def txt_tokens(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


def frequent(docs: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, word, n, total: the k most frequent tokens of each document; ties go to the first met.

    They are counted and cut within the row; only rows that share a doc_id are brought together.
    """
    t = docs.select("doc_id", text.tokens(F.col("text")).alias("t"))
    best = lambda c: F.slice(F.sort_array(F.transform(c, lambda x: F.struct((-x["n"]).alias("less"), x["first"].alias("first"), x["word"].alias("word")))), 1, k)
    row = lambda d: d.select("doc_id", F.size("t").alias("total"), F.posexplode(best(text.counted(F.col("t")))).alias("at", "w")).select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), "w.word", (-F.col("w.less")).alias("n"), "total")
    shared = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared"))
    if shared.isEmpty():
        return row(t)
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    seen = t.join(shared, same, "left_semi").select("doc_id", F.size("t").alias("total"), F.inline(text.counted(F.col("t"))))
    n = seen.groupBy("doc_id", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.first("total").alias("total"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    merged = n.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", "word", "n", "total")
    return row(t.join(shared, same, "left_anti")).unionByName(merged)


def keywords(docs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tokens of each document with their share; ties go to the first met."""
    return frequent(docs, k).select("doc_id", "rank", "word", F.round(F.col("n") / F.col("total"), 6).alias("weight"))


@query(
    f"""with t as (select doc_id, {_TOKENS} as t from documents), e as (select doc_id, len(t) as total, unnest(t) as word, generate_subscripts(t, 1) as pos from t),
    n as (select doc_id, word, count(*) as n, min(pos) as first, any_value(total) as total from e group by all)
    select doc_id, row_number() over (partition by doc_id order by n desc, first)::bigint as rank, word, round(n / total, 6) as weight from n qualify rank <= 10"""
)
def txt_keywords(spark, sf_dir):
    return keywords(read(spark, sf_dir, "documents"))


@query(f"select doc_id, len({_SENTENCES})::bigint as n_sentences, ({_SENTENCES})[1] as first_sentence from documents")
def txt_sentences(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


@query(
    r"""select doc_id, trim(regexp_replace(translate(replace(replace(text, ', ', ','), '…', '...'), '？；《》“”‘’、～－—　', '?;<>""'''',~-- '), '\s+', ' ', 'g')) as normalized from documents"""
)
def txt_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(
    f"""with f as (select doc_id, length(text) as c, len({_TOKENS}) as w, len({_SENTENCES}) as s, list_sum(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: length(x))) as l from documents)
    select doc_id, c::bigint as total_characters, w::bigint as total_words, s::bigint as total_sentences,
    round(case when w > 0 then coalesce(l, 0) / w else 0 end, 6) as avg_word_length, round(case when s > 0 then w / s else 0 end, 6) as avg_sentence_length from f"""
)
def txt_features(spark, sf_dir):
    c = F.col("text")
    w, s = text.count_words(c), text.count_sentences(c)
    letters = text.count_letters(c)
    f = read(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("total_characters"), w.cast("long").alias("total_words"), s.cast("long").alias("total_sentences"), letters.alias("l"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)
    return f.select("doc_id", "total_characters", "total_words", "total_sentences", share("l", "total_words").alias("avg_word_length"), share("total_words", "total_sentences").alias("avg_sentence_length"))


@query(f"select doc_id, len({_WORDS.format('text')})::bigint as n_words from documents")
def txt_count_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.count_words(F.col("text"), use_tokens=False).cast("long").alias("n_words"))


@query("select page_id, regexp_replace(html, '<[^\\n]*?>', '', 'g') as stripped from pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"))


@query(
    """select doc_id, i::bigint as chunk_no, substring(text, i * 450 + 1, 500) as chunk from (select doc_id, text,
    unnest(range(case when length(text) <= 500 then 1 else greatest(ceil((length(text) - 50) / 450.0), 1)::bigint end)) as i from documents)"""
)
def char_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.char_chunks(F.col("text"), 500, 50)).alias("i", "chunk"))
    return d.select("doc_id", F.col("i").cast("long").alias("chunk_no"), "chunk")


def _reduced(items: str, state: str, step: str, rows: str) -> str:
    """A fold in SQL: every item becomes a state whose current text it is; step joins acc and x."""
    return f"select *, list_reduce(list_transform({items}, lambda s: {state.format('s')}), lambda acc, x: {step}, {state.format(chr(39) * 2)}) as r from ({rows})"


_CHUNK = "{{'c': []::varchar[], 'cur': {}}}"
_PARTS = "case when length(text) <= 500 then [text] when {0} = '' then r.c else list_append(r.c, {0}) end"
_TRIM = "trim({}, E' \t\n\r')"


@query(
    "select doc_id, generate_subscripts(p, 1) - 1 as chunk_no, unnest(p) as chunk from (select doc_id, "
    + _PARTS.format(_TRIM.format("r.cur")) + " as p from ("
    + _reduced(
        _SENTENCES, _CHUNK,
        f"case when length(acc.cur) + length(x.cur) + 1 > 500 and acc.cur <> '' then {{'c': list_append(acc.c, {_TRIM.format('acc.cur')}), 'cur': right(acc.cur, 20) || ' ' || x.cur}} "
        "when acc.cur = '' then {'c': acc.c, 'cur': x.cur} else {'c': acc.c, 'cur': acc.cur || ' ' || x.cur} end",
        "select doc_id, text from documents",
    ) + "))"
)
def sentence_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"), 500, 20)).alias("i", "chunk"))
    return d.select("doc_id", F.col("i").cast("long").alias("chunk_no"), "chunk")


_TAIL = "case when length(acc.cur) < 40 then acc.cur else regexp_replace(right(acc.cur, 40), '^[^ ]*( |$)', '') end"


@query(
    "select doc_id, generate_subscripts(p, 1) - 1 as chunk_no, unnest(p) as chunk from (select doc_id, "
    + _PARTS.format("r.cur") + " as p from ("
    + _reduced(
        _TOKENS, _CHUNK,
        "case when length(acc.cur) + length(x.cur) + 2 > 500 and acc.cur <> '' then {'c': list_append(acc.c, acc.cur), 'cur': case when " + _TAIL + " = '' then x.cur else " + _TAIL + " || ' ' || x.cur end} "
        "when acc.cur = '' then {'c': acc.c, 'cur': x.cur} else {'c': acc.c, 'cur': acc.cur || ' ' || x.cur} end",
        "select doc_id, text from documents",
    ) + "))"
)
def token_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.token_chunks(F.col("text"), 500, 40)).alias("i", "chunk"))
    return d.select("doc_id", F.col("i").cast("long").alias("chunk_no"), "chunk")


_GAPS = "(len(string_split(acc.cur, ' ')) - 1)"
_ROOM = "(80 - length(replace(acc.cur, ' ', '')))"
_JUSTIFIED = f"case when {_GAPS} < 1 then acc.cur else array_to_string(list_transform(string_split(acc.cur, ' '), lambda w, i: case when i <= {_GAPS} then w || repeat(' ', ({_ROOM} // {_GAPS} + (i <= {_ROOM} % {_GAPS})::int)::bigint) else w end), '') end"


@query(
    "select conv_id, turn, array_to_string(case when r.cur = '' then r.c else list_append(r.c, r.cur) end, E'\\n') as wrapped from ("
    + _reduced(
        _WORDS.format("text"), _CHUNK,
        f"case when length(acc.cur) + length(x.cur) + (acc.cur <> '')::int > 80 then {{'c': list_append(acc.c, {_JUSTIFIED}), 'cur': x.cur}} when acc.cur = '' then {{'c': acc.c, 'cur': x.cur}} else {{'c': acc.c, 'cur': acc.cur || ' ' || x.cur}} end",
        "select conv_id, turn, text from conversations",
    ) + ")"
)
def txt_wrap(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.wrap(F.col("text"), 80, justified=True).alias("wrapped"))


_EVAL = "lower(regexp_replace(regexp_replace(text, '" + _PUNCT + "', '', 'g'), '[, .!？；:‘’“”\\[\\]()《》、—…]', '', 'g'))"


@query(f"select doc_id, array_to_string({_WORDS.format(_EVAL)}, '|') as tokens from documents")
def eval_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.eval_normalize(F.col("text")), "|").alias("tokens"))


@query(
    f"""with w as (select conv_id, turn, list_distinct({_WORDS.format('lower(text)')}) as a, list_distinct({_WORDS.format('lower(lag(text) over (partition by conv_id order by turn))')}) as b from conversations)
    select conv_id, turn, round(case when len(a) + len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0 end, 6) as similarity from w where b is not null"""
)
def jaccard_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return c.select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("before")), 6).alias("similarity"))


@query("select vec_id, case when label % 2 = 0 then '[' || vec_id || ', ' || label || '.5]' else '[-' || vec_id || ']' end as text, label % 2 = 0 as is_vector from embeddings")
def vector_text_filter(spark, sf_dir):
    t = F.when(F.col("label") % 2 == 0, F.concat(F.lit("["), "vec_id", F.lit(", "), "label", F.lit(".5]"))).otherwise(F.concat(F.lit("[-"), "vec_id", F.lit("]")))
    return read(spark, sf_dir, "embeddings").select("vec_id", t.alias("text")).withColumn("is_vector", text.is_vector_text(F.col("text")))


@query(
    r"""with a as (select conv_id, turn, case when turn = 0 then 'I don''t know' else '**' || text || E'**\n- ' || text || E'\n\n* end' end as t from conversations),
    b as (select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*([^\n]*?)\*\*', '\1', 'g'), '\*([^\n]*?)\*', '\1', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '\s+', ' ', 'g')) as t from a)
    select conv_id, turn, case when lower(t) = 'i don''t know' then '' else t end as answer from b"""
)
def answer_cleanup(spark, sf_dir):
    t = F.when(F.col("turn") == 0, "I don't know").otherwise(F.concat(F.lit("**"), "text", F.lit("**\n- "), "text", F.lit("\n\n* end")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.clean_answer(t).alias("answer"))


_LINES = f"""with l as (select doc_id, unnest(string_split(t, E'\\n')) as line, generate_subscripts(string_split(t, E'\\n'), 1) as pos from (select doc_id, regexp_replace(text, '[{ocr.NOISE}]{{5,}}', '', 'g') as t from documents)),
k as (select * from (select *, count(*) over (partition by doc_id, line) as n from l) where n < 3 and length(trim(line, E' \\t\\r')) > 10 and len({_WORDS.format('line')}) > 2),
j as (select doc_id, string_agg(line, E'\\n' order by pos) as text from k group by doc_id),
n as (select doc_id, len({_WORDS.format('text')}) as n from documents)
select j.doc_id, j.text, len({_WORDS.format('j.text')})::bigint as n_left, n.n::bigint as n_words from j join n using (doc_id) where n.n > 0 and len({_WORDS.format('j.text')}) / n.n > 0.3"""


@query(_LINES)
def ocr_clean_lines(spark, sf_dir):
    return ocr.clean_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""with c as (select doc_id, i as rank, substring(text, i * 300 + 1, 300) as text from (select doc_id, text, unnest(range(ceil(length(text) / 300.0)::bigint)) as i from documents)),
    n as (select *, len({_WORDS.format('text')}) as n from c), s as (select *, sum(n) over (partition by doc_id order by rank) as total from n),
    o as (select *, coalesce(max((total > 400)::int) over (partition by doc_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from s)
    select doc_id, rank::bigint as rank, (case when total > 400 then 400 - (total - n) else n end)::bigint as n_words, total > 400 as truncated,
    case when total > 400 then array_to_string(({_WORDS.format('text')})[1:(400 - (total - n))::bigint], ' ') else text end as text from o where before = 0 and (total <= 400 or 400 - (total - n) > 20)"""
)
def context_budget(spark, sf_dir):
    t = F.col("text")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / 300).cast("int"), F.lit(1)) - 1), lambda i: F.substring(t, i * 300 + 1, F.lit(300)))
    c = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(pieces).alias("rank", "text")).withColumn("rank", F.col("rank").cast("long"))
    return ocr.budget(c, 400, key="doc_id", worth=20).select("doc_id", "rank", "n_words", "truncated", "text")


_SET = f"list_distinct({_WORDS.format('lower({})')})"


def _greedy(items: str, rows: str) -> str:
    """The greedy choice in SQL: items as (text, set) pairs, kept ones in k, at most ten."""
    pair = f"{{'t': s, 'w': {_SET.format('s')}}}"
    both = "len(list_intersect(y.w, x.k[1].w))"
    near = f"len(list_filter(acc.k, lambda y: case when len(y.w) + len(x.k[1].w) > 0 then {both} / (len(y.w) + len(x.k[1].w) - {both}) else 0 end > 0.9)) > 0"
    return f"select *, list_reduce(list_transform({items}, lambda s: {{'k': [{pair}]}}), lambda acc, x: case when len(acc.k) >= 10 or {near} then acc else {{'k': list_concat(acc.k, x.k)}} end) as g from ({rows})"


@query(
    "select doc_id, (generate_subscripts(g, 1) - 1)::bigint as pos, unnest(g) as sentence from (select doc_id, list_transform(g.k, lambda y: y.t) as g from ("
    + _greedy(_SENTENCES, f"select doc_id, text from documents where len({_SENTENCES}) > 0") + "))"
)
def near_dup_greedy(spark, sf_dir):
    """Per document, its sentences chosen greedily so that none is over 0.9 similar to an earlier one, up to the first ten chosen (the operator's ``most``, a top-k)."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(ocr.near_distinct(text.sentences(F.col("text")))).alias("i", "sentence"))
    return d.select("doc_id", F.col("i").cast("long").alias("pos"), "sentence")


_MARKER = ocr.MARKER
_CHUNKED = f"""case when length(text) = 0 then [] when len(regexp_split_to_array(text, '{_MARKER}')) < 3 then list_transform(range(ceil(length(text) / 300.0)::bigint), lambda i: substring(text, i * 300 + 1, 300))
  else list_transform(list_filter(regexp_split_to_array(text, '{_MARKER}'), lambda p: len({_WORDS.format('p')}) > 50), lambda p: {_TRIM.format('p')}) end"""


_ASKED = f"list_distinct(list_transform(({_WORDS.format('text')})[-8:], lambda w: lower(w)))"
_RELEVANT = (
    "list_transform(list_sort(list_transform(range(1, len(parts) + 1), lambda i: {'s': -1.0 * (case when len(a) + len(" + _SET.format("parts[i]") + ") > 0 then len(list_intersect(a, " + _SET.format("parts[i]") + ")) / "
    "(len(a) + len(" + _SET.format("parts[i]") + ") - len(list_intersect(a, " + _SET.format("parts[i]") + "))) else 0 end), 'i': i})), lambda x: parts[x.i])"
)


@query(
    f"""with c as (select doc_id, ['what', 'changed'] as a, {_CHUNKED} as parts from ({_LINES})), r as (select doc_id, {_RELEVANT} as parts from c where len(parts) > 0), g as ({_greedy('parts', 'select * from r')}),
    e as (select doc_id, generate_subscripts(t, 1) - 1 as rank, unnest(t) as text from (select doc_id, list_transform(g.k, lambda y: y.t) as t from g)),
    n as (select *, len({_WORDS.format('text')}) as n from e), s as (select *, sum(n) over (partition by doc_id order by rank) - n as before from n)
    select doc_id, rank::bigint as rank, (case when before + n > 500 then 500 - before else n end)::bigint as n_words, before + n > 500 as truncated,
    case when before + n > 500 then array_to_string(({_WORDS.format('text')})[1:(500 - before)::bigint], ' ') else text end as text from s where before <= 500 and (before + n <= 500 or 500 - before > 100)"""
)
def ocr_compress(spark, sf_dir):
    """Noise, chunks by relevance, near duplicates (at most ten chunks kept, a top-k) and budget of every document."""
    return ocr.compress(read(spark, sf_dir, "documents").select("doc_id", "text"), "what changed", 500).select("doc_id", F.col("rank").cast("long").alias("rank"), "text", "n_words", "truncated")


@query(
    f"""with q as (select doc_id, {_ASKED} as a from documents), c as (select doc_id, a, {_CHUNKED} as parts from ({_LINES}) join q using (doc_id)), r as (select doc_id, {_RELEVANT} as parts from c where len(parts) > 0),
    g as ({_greedy('parts', 'select * from r')}) select doc_id, generate_subscripts(t, 1)::bigint - 1 as rank, unnest(t) as text from (select doc_id, list_transform(g.k, lambda y: y.t) as t from g)"""
)
def ocr_relevance(spark, sf_dir):
    """The chunks of every document by their likeness to its own last eight words, near duplicates left out (at most ten chunks kept, a top-k)."""
    last = text.let(text.words(F.col("text")), lambda w: F.slice(w, F.greatest(F.size(w) - 7, F.lit(1)), F.lit(8)))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(last, " ").alias("asked"))
    return ocr.compress(d, F.col("asked"), 1_000_000_000).select("doc_id", F.col("rank").cast("long").alias("rank"), "text")


_ENDS = "list_transform(range(1, len({p})), lambda i: list_sum(list_transform(({p})[1:i], lambda y: length(y))) + i * length(e))"
_WINDOWS = "list_transform(" + _ENDS.format(p="regexp_split_to_array(text, '(?i)' || e)") + ", lambda z: substring(text, greatest(z - length(e) - 100, 0)::bigint + 1, (z + 100 - greatest(z - length(e) - 100, 0))::bigint))"
_ENTITIES = "list_sort(list_distinct(regexp_extract_all(string_split(text, ' ')[1], '[A-Z][a-z]+|[A-Z]+|[一-龥]+')))"
_FOUND = rf"""array_to_string(list_concat(regexp_extract_all(text, '{ocr.NUMBER}'), list_concat(regexp_extract_all(text, '(?s)(?:Table|Figure)\s*\d+[^\n]*\n.{{0,500}}'),
  list_concat(regexp_extract_all(text, 'Page\s+\d+[^\n]*\n[^\n]{{0,300}}'), flatten(list_transform({_ENTITIES}, lambda e: {_WINDOWS}))))), E'\n')"""


@query(
    f"""select conv_id, turn, case when len({_WORDS.format('found')}) > 2000 then regexp_replace(found, '\b(?:{'|'.join(text.ADVERBS)})\b', '', 'g') else found end as extract from (select conv_id, turn, {_FOUND} as found from conversations)"""
)
def ocr_precision(spark, sf_dir):
    """For each question of the conversations, the precision extract of its own text."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ocr.precision_extract(F.substring_index("text", " ", 1), F.col("text")).alias("extract"))


@query("select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+|[A-Z]+|[一-龥]+'))), ' ') as entities from benchmark")
def txt_entities(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.entities(F.col("text")), " ").alias("entities"))


@query(rf"select conv_id, turn, regexp_replace('very ' || text || ' clearly', '\b(?:{'|'.join(text.ADVERBS)})\b', '', 'g') as plain from conversations")
def drop_descriptive(spark, sf_dir):
    c = F.concat(F.lit("very "), "text", F.lit(" clearly"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.drop_descriptive(c).alias("plain"))


@query("select event_id, case event_id % 3 when 0 then event_type when 1 then event_type || ' ' || user_id else '{' || event_type end as text from events")
def json_hit_text(spark, sf_dir):
    """Texts of hits that are JSON objects, arrays or neither."""
    k = F.col("event_id") % 3
    obj = F.concat(F.lit('{"text": "'), "event_type", F.lit('", "n": 1}'))
    arr = F.concat(F.lit('[{"text": "'), "event_type", F.lit('"}, 7, {"text": "'), "user_id", F.lit('"}]'))
    raw = F.when(k == 0, obj).when(k == 1, arr).otherwise(F.concat(F.lit("{"), "event_type"))
    return read(spark, sf_dir, "events").select("event_id", parsing.json_text(raw).alias("text"))


@query("select event_id, case event_id % 4 when 0 then event_type when 1 then event_type || ' x' when 2 then user_id::varchar else null end as text from events")
def json_corpus_text(spark, sf_dir):
    """Texts of JSON corpus files: an object, a list, a scalar, and a malformed one."""
    k = F.col("event_id") % 4
    obj = F.concat(F.lit('{"text": "'), "event_type", F.lit('"}'))
    arr = F.concat(F.lit('[{"text": "'), "event_type", F.lit('"}, "x"]'))
    raw = F.when(k == 0, obj).when(k == 1, arr).when(k == 2, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("{"), "event_type"))
    return read(spark, sf_dir, "events").select("event_id", parsing.corpus_text(raw).alias("text"))


@query("select page_id, lower(regexp_extract(p, '\\.([A-Za-z]+)$', 1)) in ('jpg', 'jpeg', 'png', 'gif', 'bmp') as is_image from (select page_id, url || case page_id % 4 when 0 then '.PNG' when 1 then '.jpeg' when 2 then '.txt' else '' end as p from pages)")
def image_paths(spark, sf_dir):
    p = F.concat("url", F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".txt", ""))), (F.col("page_id") % 4 + 1).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", text.is_image_path(p).alias("is_image"))


@query("select item_id, 'data:image/png;base64,' || to_base64(encode(text)) as uri from benchmark")
def image_data_uri(spark, sf_dir):
    from hopweave.sources.nodes import data_uri

    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.replace(data_uri(F.lit("a/b.PNG"), F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("uri"))


@query("select doc_id, case when starts_with(path, './data/') then '/mnt/root' || substr(path, 7) else path end as path from (select doc_id, case when doc_id % 2 = 0 then './data/' || source else '/abs/' || source end as path from documents)")
def path_rewrite(spark, sf_dir):
    p = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./data/"), "source")).otherwise(F.concat(F.lit("/abs/"), "source"))
    return read(spark, sf_dir, "documents").select("doc_id", text.rewrite_path(p, "/mnt/root").alias("path"))
