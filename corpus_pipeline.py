"""From raw documents to packed sequences, stage by stage.

Each stage takes the table that the one before wrote and returns a table that
is written as Parquet and read again.  All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from loomframe.llm.common import fresh
from loomframe.session import durable, release, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    own = fresh(docs, "toxicity")
    scored = toxicity.score(docs, model, name=own)
    return scored.where(F.col(f"{own}.score") < queries.TOXIC).drop(own)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a near copy that stays before them go."""
    return simhash.deduplicate(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, in random order."""
    return mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_SEED).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a power of two long."""
    return packing.pack(docs, limit=2048, end_id=1, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens and learned words have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as made:
            after = durable(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            made.remove(after)
        release(docs)
        docs = after
    return docs
