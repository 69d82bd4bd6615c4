"""The corpus pipeline: quality, language, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first three return
the rows they keep with the columns of ``documents``; the last returns the packed pieces.

Cases: null or empty texts have no letter, so the language stage lets them go (as it does what no language
can be told of, and texts unlike any language learned); without any label the quality stage keeps all, without
any language the language stage. Rows with a null doc_id pass the near-duplicate stage; of rows that repeat a
doc_id it keeps one. Very long texts pass whole. Extra columns pass through all filtering stages. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import langid, ngram_join, packing, quality
from hopweave.llm._common import bounded_batches, stored, table

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier, learned from the labels, finds likelier good than bad."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in one of the languages of the corpus with a probability of at least one half, and like its texts."""
    bounded_batches(spark)
    return langid.keep_known(docs, langid.fit(docs), threshold=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    bounded_batches(spark)
    return ngram_join.keep_firsts(docs, n=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences of 4096 tokens."""
    bounded_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), remembered=packing.FEWER)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Statistical models and token packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
