"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet to the cluster's shared
folder and reads again as the next one's ``docs``. All but the last return the columns of ``documents``, whatever those are beside
``doc_id``, ``text``, ``source`` and ``n_chars``; operators put no column beside them whose name could clash and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from spindrift.llm.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts.

    Null and empty texts score as texts without any term, so they stay; repeated rows are judged alike; without labelled
    rows only a list of insults speaks. An empty table stays empty."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that exceed the boilerplate ratio of their source.

    Null texts stay null; documents that lose all their lines stay with an empty text; ``n_chars`` is counted anew for
    changed texts only; a null source is a source of its own."""
    cleaned = line_dedup.drop_boilerplate(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its least id, and of several such rows the one of least text.

    Rows are judged by their own text, also where an id is repeated. Null and empty texts are groups of their own, one for
    each id; a null id gives way to any other."""
    return ngram_join.representatives(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts hold none and stay; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents' ids and of the texts that those decode to, one row for each of
    them; null counts as empty."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: The toxicity classifier, the join by shingles and the encoder can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
