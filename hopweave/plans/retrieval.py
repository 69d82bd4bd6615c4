"""The question pipeline: plan, decompose, retrieve, fuse; all questions advance together."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.config import Settings
from hopweave.functions import parsing
from hopweave.functions.text import valid_query
from hopweave.operators import fusion, planning, replies, vector
from hopweave.plans.providers import ModelSpec, embed, embed_image, generate, rerank_score
from hopweave.storage import checkpointed

#: What the models are asked; the question comes last.
PLAN = 'Rate the question. Reply with JSON only: {"score": {"modality_complexity": 1 to 3, "multi_hop_complexity": 1 to 5}}.\nQuestion: '
DECOMPOSE = 'Split the question into two to five sub-questions; in a chain, write [Answer from Qn] for an earlier answer. Reply with JSON only: {"sub_questions": [{"text": "..."}]}.\nRouting: '
REVIEW = 'Improve the sub-questions. Reply with JSON only: {"refined_subqueries": [{"question": "...", "type": "Independent or Bridging", "dependencies": ["Q1"]}]}.\nSub-questions:\n'


CONFIDENCE = "Rate your confidence that you can answer without any documents. Reply with 'Score: x', x from 0 to 1.\nQuestion: "
CHOOSE = "Choose the retrieval for the question: local_text, cross_modal or hybrid. Reply with the one word.\nQuestion: "
KNOWLEDGE = "Answer briefly from general knowledge.\nQuestion: "
STRATEGIES = ("local_text", "cross_modal", "hybrid")
#: Columns of a question that its answer carries on.
CARRIED = ("id", "metadata", "ground_truth")
_HITS = "query_id long, rank int, node_id long, score double, text string, source string, modality string, retrieval_source string, modality_order int, position int"

log = logging.getLogger(__name__)


@dataclass
class Answered:
    """answers: one row per question; steps: the sub-answers (question_id, id, sub_ord, error, answer); hits: the retrieval trace in order of sub_ord and rank."""

    answers: DataFrame
    steps: DataFrame
    hits: DataFrame


@dataclass
class Engine:
    """Corpora and models. nodes: (node_id long, text, vector, modality, source); ``stored``: they are a table, not a plan.

    Text nodes have the embedder's vectors, image nodes the image embedder's (the embedder's where there is none).
    Without a reranking model hits are scored by word overlap.
    """

    spark: SparkSession
    nodes: DataFrame
    settings: Settings = field(default_factory=Settings)
    llm: ModelSpec = field(default_factory=ModelSpec)
    embedder: ModelSpec = field(default_factory=ModelSpec)
    retrievers: dict = field(default_factory=dict)
    image_embedder: ModelSpec | None = None
    reranker: ModelSpec | None = None
    stored: bool = False

    def __post_init__(self):
        self.retrievers = {"local_text": self._by_modality("text"), "cross_modal": self._by_modality("image"), **self.retrievers}

    def register(self, name: str, retriever) -> None:
        """A retriever is (queries, k) -> hits."""
        self.retrievers[name] = retriever

    def available(self) -> list[str]:
        return sorted(self.retrievers)

    def info(self) -> dict[str, dict]:
        """What is known of each retriever: whether it is built in, its modality and model."""
        own = {"local_text": ("text", self.embedder), "cross_modal": ("image", self.image_embedder or self.embedder)}
        return {n: {"built_in": n in own, "modality": own.get(n, (None, None))[0], "model": own[n][1].model if n in own else None} for n in self.available()}

    def table(self) -> DataFrame:
        """The nodes as a table: embedded once, however many levels and modalities read them."""
        if not self.stored:
            self.nodes, self.stored = checkpointed(self.nodes, "nodes"), True
        return self.nodes

    def _by_modality(self, name: str):
        def run(queries: DataFrame, k: int) -> DataFrame:
            mine = self.table().where(F.col("modality") == name)
            spec = self.image_embedder or self.embedder if name == "image" else self.embedder
            search = lambda q, n: vector.top_k(q, mine.select("node_id", "vector"), n)
            asked = queries if spec == self.embedder else queries.withColumn("vector", embed(F.col("question"), spec)).where("vector is not null")
            if name == "image" and "images" in queries.columns:
                shown = queries.select("query_id", F.posexplode("images").alias("image_seq", "image"))
                shown = checkpointed(shown.withColumn("vector", embed_image(F.col("image"), spec)).where("vector is not null").withColumn("shown", F.xxhash64("query_id", "image_seq")))
                found = search(shown.select(F.col("shown").alias("query_id"), "vector"), 2 * k).withColumnRenamed("query_id", "shown")
                found = found.join(shown.select("shown", F.col("query_id").alias("question_id"), "image_seq"), "shown").join(mine.select("node_id", "text"), "node_id")
                mean = vector.multi_vector_average(found, k).select(F.col("question_id").alias("query_id"), "rank", "node_id", "score")
                rest = asked.join(shown.select("query_id").distinct(), "query_id", "left_anti")
                hits = mean.unionByName(search(rest.select("query_id", "vector"), k))
            else:
                hits = search(asked.select("query_id", "vector"), k)
            return hits.join(mine.select("node_id", "text", "source"), "node_id")

        return run

    def retrieve(self, queries: DataFrame, strategy: str = "local_text", methods: tuple = ("local_text", "cross_modal")) -> DataFrame:
        """Hits of (query_id, question[, images]): retrieve k, rerank, cut; hybrid joins the methods' lists, without those that fail."""
        k, rk = self.settings.retrieval_top_k, self.settings.rerank_top_k
        asked = checkpointed(queries.where(valid_query(F.col("question"))).withColumn("vector", embed(F.col("question"), self.embedder)).where("vector is not null"))
        if strategy == "hybrid" and len(methods) > 1:
            parts = []
            for m in methods:
                try:
                    parts.append(("image" if m == "cross_modal" else "text", m, checkpointed(self._ranked(asked, m, k, rk))))
                except Exception:  # noqa: BLE001 - the other methods' hits are still good
                    log.exception("retrieval by %s failed, left out", m)
            return vector.hybrid_union(parts, rk) if parts else self.spark.createDataFrame([], _HITS)
        name = methods[0] if strategy == "hybrid" else strategy if strategy in self.retrievers else "local_text"
        return vector.hybrid_union([("image" if name == "cross_modal" else "text", name, self._ranked(asked, name, k, rk))], rk)

    def _ranked(self, asked: DataFrame, name: str, k: int, rk: int) -> DataFrame:
        hits = self.retrievers[name](asked, k)
        if not self.settings.rerank_enabled:
            return vector.truncate(hits, rk)
        full = hits.join(asked.select("query_id", "question"), "query_id")
        if not self.reranker:
            return vector.rerank(full, vector.lexical_score(F.col("question"), F.col("text")), rk).drop("question")
        image = F.col("source") if name == "cross_modal" else F.lit(None).cast("string")
        scored = full.withColumn("told", rerank_score(F.col("question"), F.col("text"), image, self.reranker))
        return vector.rerank(scored, F.coalesce("told", "score"), rk).drop("question", "told")

    def judged(self, queries: DataFrame) -> DataFrame:
        """query_id, confidence, needed, strategy of (query_id, question): the model's confidence without documents against the threshold, and the retrieval it names."""
        ask = lambda text, name: self._told(queries.select("query_id", F.concat(F.lit(text), "question").alias("prompt"))).select("query_id", F.col("reply").alias(name))
        told = ask(CONFIDENCE, "c").join(ask(CHOOSE, "s"), "query_id")
        score = parsing.confidence(F.col("c"))
        return told.select("query_id", F.coalesce(score, F.lit(0.0)).alias("confidence"), parsing.needs_retrieval(score, self.settings.confidence_threshold).alias("needed"), parsing.strategy(F.col("s")).alias("strategy"))

    def _fetched(self, asked: DataFrame, strategy: str) -> DataFrame:
        """Hits of (query_id, question, images) by the given strategy or, for ``auto``, by the one the model names; none where the gate finds retrieval needless."""
        if strategy != "auto" and not self.settings.gated:
            return self.retrieve(asked, strategy)
        judged = checkpointed(asked.join(self.judged(asked), "query_id"))
        if self.settings.gated:
            judged = judged.where("needed")
        if strategy != "auto":
            return self.retrieve(judged.select(asked.columns), strategy)
        out = None
        for name in STRATEGIES:
            mine = judged.where(F.col("strategy") == name)
            if not mine.isEmpty():
                got = self.retrieve(mine.select(asked.columns), name)
                out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        return self.spark.createDataFrame([], _HITS) if out is None else out

    def _told(self, prompts: DataFrame) -> DataFrame:
        """Replies to prompts, asked once however often they are read."""
        return checkpointed(generate(prompts, self.llm))

    def plan(self, questions: DataFrame) -> DataFrame:
        """Complexities and routing by the planner's reply; where it can't be read, modality from images and hops from the question's structure."""
        told = self._told(questions.select("question_id", F.concat(F.lit(PLAN), "question").alias("prompt"))).select("question_id", F.col("reply").alias("plan_reply"))
        scored = questions.join(told, "question_id", "left")
        plan = replies.planned(F.col("plan_reply"), F.col("question"), F.col("information.images"), F.lit(None).cast("double"), self.settings.confidence_threshold)
        hops = F.col("plan.multi_hop_complexity")
        return scored.withColumn("plan", plan).withColumns({
            "modality_complexity": F.col("plan.modality_complexity"), "multi_hop_complexity": hops, "routing": parsing.route(hops.cast("string")),
        }).drop("plan", "plan_reply")

    def _split(self, planned: DataFrame) -> DataFrame:
        """Sub-questions of the decomposer's reply; where none can be read, the parts that the structure names, else the fixed chain."""
        told = self._told(planned.select("question_id", "routing", F.concat(F.lit(DECOMPOSE), "routing", F.lit("\nQuestion: "), "question").alias("prompt")))
        read = checkpointed(planning.normalise_subquestions(replies.decomposed(told)))
        rest = planned.join(read.select("question_id").distinct(), "question_id", "left_anti")
        parts = F.filter(F.split("question", r"、|,| and "), lambda s: F.trim(s) != "")
        many = rest.where("routing = 'parallel_processing'").select("question_id", F.posexplode(parts).alias("ord", "text"), F.lit(None).cast("string").alias("question"), "routing")
        chain = planning.fallback_subquestions(rest.where("routing = 'bridge_processing'"))
        return read.unionByName(planning.normalise_subquestions(many)).unionByName(chain)

    def _reviewed(self, subs: DataFrame) -> DataFrame:
        """Sub-questions as the reviewer's reply refines them."""
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "question"))), lambda s: F.concat(s["id"], F.lit(": "), s["question"])), "\n")
        told = self._told(subs.groupBy("question_id").agg(F.concat(F.lit(REVIEW), lines).alias("prompt")))
        new = replies.refined(subs.select("question_id", "pos", "question", "type", "depends_on"), told.select("question_id", "reply"))
        name = lambda d: F.regexp_replace(d, r"^sub_(\d+)\z", "Q$1")
        new = new.withColumns({"id": F.concat(F.lit("Q"), "pos"), "sub_id": F.concat(F.lit("sub_"), "pos"), "depends_on": F.transform("depends_on", name)})
        return new.where(F.trim("question") != "").join(subs.select("question_id", "routing").distinct(), "question_id").select(subs.columns)

    def decompose(self, planned: DataFrame) -> DataFrame:
        """Sub-questions: the question itself where one hop does, else decomposed and reviewed, again where the review rejects them.

        After the last attempt, rejected ones stay if they are two to five; questions with none get the fixed chain.
        """
        planned = checkpointed(planned)
        done = planning.direct_subquestion(planned.where("routing = 'no_decomposition'"))
        left = planned.where("routing <> 'no_decomposition'")
        for attempt in range(max(self.settings.decomposition_attempts, 1)):
            if left.isEmpty():
                return done
            subs = checkpointed(self._reviewed(checkpointed(self._split(left))))
            judged = planning.accept_after_retries(planning.review(subs)) if attempt + 1 >= self.settings.decomposition_attempts else planning.review(subs).withColumn("accepted", F.col("status") == "approved")
            good = checkpointed(judged.where("accepted").select("question_id"))
            done = done.unionByName(subs.join(good, "question_id", "left_semi"))
            left = checkpointed(left.join(good, "question_id", "left_anti"))
        return done.unionByName(planning.fallback_subquestions(left))

    def answer(self, questions: DataFrame, strategy: str = "local_text", max_levels: int | None = None, retrieval: bool = True) -> DataFrame:
        """The answers of answered()."""
        return self.answered(questions, strategy, max_levels, retrieval).answers

    def answered(self, questions: DataFrame, strategy: str = "local_text", max_levels: int | None = None, retrieval: bool = True) -> Answered:
        """question_id, question, answer, sources, n_hits, error and what the question carries, with the steps and the hits.

        All levels unless given fewer, sub-questions on a cycle last. strategy ``auto`` lets the model choose;
        without retrieval, answers come from the model alone. Rows whose question is blank get an error instead.
        """
        good = questions.where(valid_query(F.col("question")))
        pictures = good.select("question_id", F.coalesce("information.images", F.array().cast("array<string>")).alias("images"))
        subs = checkpointed(self.decompose(self.plan(good)))
        nodes = subs.select(F.col("question_id").alias("graph"), "id")
        edges = subs.select(F.col("question_id").alias("graph"), "id", F.explode("depends_on").alias("depends_on"))
        placed = checkpointed(subs.join(planning.levels(nodes, edges).withColumnsRenamed({"graph": "question_id"}), ["question_id", "id"]).join(pictures, "question_id"))
        depths = sorted((r["level"] for r in placed.select("level").distinct().collect()), key=lambda n: (n < 0, n)) or [0]
        answers, hits = None, None
        for level in depths if max_levels is None else depths[: max_levels + 1]:
            now = placed.where(F.col("level") == level)
            if answers is None:
                ready = now.withColumn("known", F.create_map().cast("map<string,string>"))
            else:
                known = answers.groupBy("question_id").agg(F.map_from_entries(F.flatten(F.collect_list(F.transform(planning.aliases(F.col("id")), lambda i: F.struct(i.alias("k"), F.col("answer").alias("v")))))).alias("known"))
                ready = now.join(known, "question_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
            asked = ready.withColumn("enhanced", planning.resolve(F.col("question"), F.col("known"), F.col("depends_on")))
            asked = checkpointed(asked.withColumn("query_id", F.xxhash64("question_id", "id")).drop("known"))
            wanted = asked.select("query_id", F.col("enhanced").alias("question"), "images")
            got = self._fetched(wanted, strategy) if retrieval else self.spark.createDataFrame([], _HITS)
            got = got.join(asked.select("query_id", "question_id", F.col("pos").alias("sub_ord")), "query_id").withColumn("rank", F.col("position")).drop("position")
            got = checkpointed(got)
            prompts = asked.join(fusion.context(got.withColumn("question_id", F.col("query_id"))).withColumnRenamed("question_id", "query_id"), "query_id", "left")
            told = generate(prompts.select("question_id", "id", F.col("pos").alias("sub_ord"), fusion.prompt(F.col("enhanced"), F.col("context")).alias("prompt")), self.llm)
            here = checkpointed(told.select("question_id", "id", "sub_ord", F.nullif("reply_error", F.lit("")).alias("error"), parsing.clean_answer(F.col("reply")).alias("answer")))
            answers = here if answers is None else answers.unionByName(here)
            hits = got if hits is None else hits.unionByName(got, allowMissingColumns=True)
        final = fusion.context(hits.withColumn("sub_ord", F.col("sub_ord").cast("long")))
        texts = fusion.valid_subresults(answers, good).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_ord", "answer"))), lambda s: s["answer"]).alias("sub_answers"))
        ready = good.join(final, "question_id", "left").join(texts, "question_id")
        told = generate(ready.select("question_id", "question", "sub_answers", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), fusion.prompt(F.col("question"), F.col("context")).alias("prompt")), self.llm)
        fused = checkpointed(told.select("question_id", "question", fusion.final_answer(F.col("reply"), F.col("sub_answers"), F.lit("")).alias("answer"), fusion.sources(F.size("sub_answers")).alias("sources"), F.col("n_hits").cast("long").alias("n_hits"), F.lit(None).cast("string").alias("error")))
        for text in (KNOWLEDGE, "Answer: "):  # what is still empty is asked of the model alone, in turn
            empty = fused.where("answer = ''")
            if empty.isEmpty():
                break
            more = self._told(empty.select("question_id", F.concat(F.lit(text), "question").alias("prompt"))).select("question_id", parsing.clean_answer(F.col("reply")).alias("more"))
            fused = checkpointed(fused.join(more, "question_id", "left").withColumn("answer", F.when(F.col("answer") == "", F.coalesce("more", F.lit(""))).otherwise(F.col("answer"))).drop("more"))
        bad = questions.where(~valid_query(F.col("question"))).select("question_id", "question", F.lit("").alias("answer"), F.array().cast("array<string>").alias("sources"), F.lit(0).cast("long").alias("n_hits"), fusion.error_record(F.lit("empty question")).alias("error"))
        carried = [c for c in CARRIED if c in questions.columns]
        done = fused.unionByName(bad)
        return Answered(done.join(questions.select("question_id", *carried), "question_id") if carried else done, answers, hits.orderBy("question_id", "sub_ord", "rank"))
