"""Golden cases of the column functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopweave.functions import parsing, text
from hopweave.functions.register import register_all
from hopweave.operators import evaluate, ocr, planning, vector
from hopweave.plans import providers, retrieval


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("r")).first()["r"]


CASES = [
    ("eval1", text.eval_normalize, "New York, N.Y.", ["newyorkny"]),
    ("eval2", text.eval_normalize, "a\tb", ["a", "b"]),
    ("eval3", text.eval_normalize, "!!!", []),
    ("par1", parsing.parallel_hops, "Compare the height of A, B, and C", 4),
    ("par2", parsing.parallel_hops, "Compare the population of France and Spain", 2),
    ("par3", parsing.parallel_hops, "Compare A, B and C", 1),
    ("par4", parsing.parallel_hops, "Comparison of A, B, C", 4),
    ("par5", parsing.parallel_hops, "What are X, Y?", 2),
    ("par6", parsing.parallel_hops, "A、B、C", 4),
    ("par7", parsing.parallel_hops, "Yes,", 1),
    ("conf1", parsing.confidence, "**Score:** 0.9", 0.9),
    ("conf2", parsing.confidence, "Score:7", 1.0),
    ("conf3", parsing.confidence, "Score: -0.2", None),
    ("conf4", parsing.confidence, "<think>Score: 0.1</think>Score: 0.8", 0.8),
    ("conf5", parsing.confidence, "score: 0.2 then Score: 0.4", 0.4),
    ("conf6", parsing.confidence, "", None),
    ("strat", parsing.strategy, "hybrid or cross_modal", "cross_modal"),
    ("route1", parsing.route, "abc", "bridge_processing"),
    ("route2", parsing.route, "2", "parallel_processing"),
    ("tidy", planning.tidy_parallel, "Who [Answer from Q1] won", "Who won"),
    ("vec1", text.is_vector_text, " [3] ", True),
    ("vec2", text.is_vector_text, "[-1, 2]", False),
    ("vec3", text.is_vector_text, "[]", False),
    ("ans1", parsing.clean_answer, "**28%**", "28%"),
    ("ans2", parsing.clean_answer, "- one\n- two", "one two"),
    ("ans3", parsing.clean_answer, "I don't know", ""),
    ("ans4", parsing.clean_answer, "*x* y", "x y"),
    ("clean1", text.clean, "Visit  https://x.com NOW, 42!", "visit  now 42"),
    ("clean2", text.clean, "It's e-mail", "its email"),
    ("clean3", text.clean, None, ""),
    ("tok", text.tokens, "The cat, the Hat", ["The", "cat", "Hat"]),
    ("html", text.strip_html, "<p>a</p>", "a"),
    ("wide", text.normalize, "Ａ１  “ｂ”… 《c》", 'A1 "b"... <c>'),
    ("json1", parsing.json_text, '{"text": "a"}', "a"),
    ("json2", parsing.json_text, '[{"text": "a"}, 3, {"text": "b"}]', "a b"),
    ("json3", parsing.json_text, "{broken", "{broken"),
    ("corpus", parsing.corpus_text, '[{"text": "a"}, "b"]', "a b"),
    ("sort", planning.sort_number, "sub_10", 10),
]


@pytest.mark.parametrize("name, f, value, want", CASES, ids=lambda x: x if isinstance(x, str) else "")
def test_golden(spark, name, f, value, want):
    assert one(spark, f(F.col("c")), value) == want


def test_chunks(spark):
    assert one(spark, text.sentence_chunks(F.col("c"), 12), "A one. B two. C three.") == ["A one B two", "C three"]
    assert one(spark, text.sentence_chunks(F.col("c"), 12, 3), "A one. B two. C three.") == ["A one B two", "two C three"]
    assert one(spark, text.char_chunks(F.col("c"), 5), "abcdefghijklm") == ["abcde", "fghij", "klm"]
    assert one(spark, text.char_chunks(F.col("c"), 5, 2), "abcdefghijklm") == ["abcde", "defgh", "ghijk", "jklm"]
    assert one(spark, text.wrap(F.col("c"), 5), "aa bb cc") == "aa bb\ncc"
    assert one(spark, text.wrap(F.col("c"), 5), "abcdefgh ij") == "\nabcdefgh\nij"
    assert one(spark, text.wrap(F.col("c"), 10, True), "aa bb cc dd") == "aa  bb  cc\ndd"


def test_similarity(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.jaccard(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert pair("a b", "B c") == pytest.approx(1 / 3)
    assert pair("", "") == 0.0
    assert one(spark, evaluate.exact_match(F.col("c"), F.lit("newyork ny")), "New York, N.Y.") == 1.0
    assert one(spark, evaluate.exact_match(F.col("c"), F.lit("ab")), "a\tb") == 0.0


def test_chain_and_review(spark):
    assert one(spark, planning.inject(F.col("c"), F.lit("Q1")), "What is its capital?") == "What is its capital based on [Answer from Q1]?"
    assert one(spark, planning.inject(F.col("c"), F.lit("Q1")), "Name it") == "Name it based on [Answer from Q1]"
    assert one(spark, planning.inject(F.col("c"), F.lit("Q1")), "see [Answer from Q7]") == "see [Answer from Q7]"
    known = F.create_map(F.lit("sub_1"), F.lit("France"), F.lit("Q1"), F.lit("France"))
    deps = F.array(F.lit("sub_1"))
    assert one(spark, planning.resolve(F.col("c"), known, deps), "Based on [Answer from Q1], x") == 'Based on "France", x'
    assert one(spark, planning.resolve(F.col("c"), known, deps), "capital from sub_1 not from sub_10") == 'capital from "France" not from sub_10'
    assert one(spark, planning.resolve(F.col("c"), known, deps), "[Answer from Q9]") == "[Answer from Q9]"
    restored = planning.restore_placeholder(F.col("c"), F.lit(2), F.lit("Bridge"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    assert one(spark, restored, "what is its capital?") == "Based on [Answer from Q1], what is its capital?"


def test_cycles(spark):
    rows = [(1, "Q1", ["Q2"]), (1, "Q2", ["Q1"]), (2, "Q1", ["Q1"]), (3, "Q1", ["Q9"]), (4, "Q1", []), (4, "Q2", ["Q1"]), (4, "Q3", ["Q1", "Q2"])]
    subs = spark.createDataFrame(rows, "question_id long, id string, depends_on array<string>")
    got = {r["question_id"]: r["status"] for r in planning.review(subs).collect()}
    assert got == {1: "rejected", 2: "rejected", 3: "approved", 4: "approved"}


def test_vectors(spark):
    v = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0],), ([5.0, 0.0, 0.0, 0.0],)], "v array<double>")
    rows = v.select(vector.normalize_query(F.col("v")).alias("q"), vector.normalize_corpus(F.col("v")).alias("n")).collect()
    assert rows[0]["q"] == [0.5] * 4 and rows[0]["n"] == [0.0] * 4 and rows[1]["q"] == [1.0, 0.0, 0.0, 0.0]
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0]), (5, None)], "node_id long, vector array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<double>")
    for limit in (64_000_000, 0):
        got = [(r["rank"], r["node_id"], r["score"]) for r in vector.top_k(asked, nodes, 2, broadcast_bytes=limit).orderBy("rank").collect()]
        assert got == [(1, 1, 1.0), (2, 2, 1.0)]
    empty = vector.top_k(asked, nodes.limit(0), 2)
    assert empty.count() == 0


def test_store(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0])], "node_id long, v array<double>")
    more = spark.createDataFrame([(2, [3.0, 4.0]), (3, [1.0])], "node_id long, v array<double>")
    got = {r["node_id"]: r["v"] for r in vector.add_one(store, more, "v", 2).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.6, 0.8]}
    assert vector.store_size(vector.add_batch(store, more, "v", 2), "v") == 1  # one wrong dimension rejects the batch
    assert vector.store_size(vector.add_batch(store, more.where("node_id = 2"), "v", 2), "v") == 2
    assert vector.store_size(vector.cleared(store), "v") == 0


def test_average_and_hybrid(spark):
    hits = spark.createDataFrame([(1, 1, 1, "a", 0.8, 7), (1, 2, 1, "a", 0.4, 8), (1, 2, 2, "b", 0.7, 9)], "question_id long, image_seq int, rank int, text string, score double, node_id long")
    got = [(r["text"], r["score"], r["node_id"]) for r in vector.multi_vector_average(hits, 5).orderBy("rank").collect()]
    assert got == [("b", 0.7, 9), ("a", 0.6, 7)]
    t = spark.createDataFrame([(1, 1, 0.1)], "query_id long, rank int, score double")
    i = spark.createDataFrame([(1, 1, 0.9)], "query_id long, rank int, score double")
    u = vector.hybrid_union([("text", "local_text", t), ("image", "cross_modal", i)], 5).orderBy("position").collect()
    assert [r["modality"] for r in u] == ["text", "image"]


def test_ocr(spark):
    docs = spark.createDataFrame([(1, "same line of words\nsame line of words\nsame line of words\nanother good line here\nx"), (2, "")], "doc_id long, text string")
    assert [r["text"] for r in ocr.clean_lines(docs).collect()] == []
    docs = spark.createDataFrame([(1, "a good long line\nanother good line here\nshort")], "doc_id long, text string")
    assert [r["text"] for r in ocr.clean_lines(docs).collect()] == ["a good long line\nanother good line here"]
    words = lambda n: " ".join(["w"] * n)
    rows = spark.createDataFrame([(1, k, words(n)) for k, n in enumerate((120, 240, 360, 120, 240, 9))], "question_id long, rank long, text string")
    assert [r["n_words"] for r in ocr.budget(rows, 1000).orderBy("rank").collect()] == [120, 240, 360, 120, 160]
    kept = one(spark, ocr.near_distinct(F.array(F.col("c"), F.col("c"), F.lit("other words")), 0.9), "a b c")
    assert kept == ["a b c", "other words"]


def test_repair():
    assert parsing.repaired("```json\n{'a': 1,}\n```") == '{"a": 1}'
    assert parsing.repaired('noise {"a": "}"} more') == '{"a": "}"}'
    assert parsing.repaired("nothing") is None


def test_sql_functions(spark):
    register_all(spark)
    r = spark.sql("select hw_jaccard('a b', 'B c') j, hw_route(4) r, size(hw_words(' a  b ')) w").first()
    assert (round(r["j"], 4), r["r"], r["w"]) == (0.3333, "parallel_processing", 2)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_repair_never_fails(s):
    parsing.repaired(s)
    parsing.repaired("{" + s + "}")


def test_ocr_precision_windows(spark):
    """Windows of occurrences under 100 characters apart overlap, as in a brute-force scan."""
    texts = ["Foo" + "x" * 95 + "Foo" + "y" * 80 + "END", "foo" * 50, "\n".join(["FOO"] * 30) + "z" * 99 + "fOo", "Foo", "é😀" * 60 + "Foo\n" + "é😀" * 60, "none", ""]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select("c", ocr.precision_extract(F.lit("Foo"), F.col("c")).alias("r")).collect()
    for r in got:
        windows = [r["c"][max(0, m.start() - 100) : m.end() + 100] for m in re.finditer("foo", r["c"], re.I)]
        assert r["r"] == "\n".join(windows), r["c"]


def test_bridge_question_end_to_end(spark, monkeypatch):
    """A model plans, decomposes, is reviewed twice (first into a cycle) and answers level by level; the other question stays whole."""
    asked_of = {"plan": 0, "split": 0, "review": 0}
    prompts = []

    def reply(prompt):
        prompts.append(prompt)
        if prompt.startswith(retrieval.PLAN):
            asked_of["plan"] += 1
            return '{"score": {"modality_complexity": 1, "multi_hop_complexity": 3}}' if "capital" in prompt else "no JSON"
        if prompt.startswith(retrieval.DECOMPOSE):
            asked_of["split"] += 1
            return '{"sub_questions": [{"text": "Which country won?"}, {"text": "What is the capital of [Answer from Q1]?"}]}'
        if prompt.startswith(retrieval.REVIEW):
            asked_of["review"] += 1
            loop = '"Q2"' if asked_of["review"] == 1 else ""
            return '{"refined_subqueries": [{"question": "Which country has won?", "type": "Independent", "dependencies": [%s]}, {"question": "What is the capital of [Answer from Q1]?", "type": "Bridging", "dependencies": ["sub_1"]}]}' % loop
        return "Paris" if 'capital of "France"' in prompt else "France" if "Which country has won?" in prompt else "Someone"

    def generate(df, spec):
        rows = [(*r, reply(r["prompt"]), None) for r in df.collect()]
        return spark.createDataFrame(rows, df.schema.add("reply", "string").add("reply_error", "string"))

    monkeypatch.setattr(retrieval, "generate", generate)
    nodes = spark.createDataFrame([(1, "which country has won", "s", "text"), (2, "what is a capital", "s", "text")], "node_id long, text string, source string, modality string")
    engine = retrieval.Engine(spark, nodes.withColumn("vector", providers.embed(F.col("text"), providers.ModelSpec())))
    schema = "question_id long, question string, information struct<text:string,images:array<string>>"
    asked = spark.createDataFrame([(1, "What is the capital of the winner?", ("", [])), (2, "Who is it?", ("", []))], schema)
    subs = engine.decompose(engine.plan(asked)).orderBy("question_id", "pos").collect()
    assert [(r["question_id"], r["id"], r["question"], list(r["depends_on"])) for r in subs] == [
        (1, "Q1", "Which country has won?", []), (1, "Q2", "What is the capital of [Answer from Q1]?", ["Q1"]), (2, "Q1", "Who is it?", [])
    ]
    assert asked_of == {"plan": 2, "split": 2, "review": 2}
    got = {r["question_id"]: r["answer"] for r in engine.answer(asked).collect()}
    assert set(got) == {1, 2} and got[2] == "Someone" and any('capital of "France"' in p for p in prompts)
