"""A corpus-cleaning pipeline over documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import materialize, table
from driftlens.llm.decontamination import drop_leaks
from driftlens.llm.mixing import mix_sources
from driftlens.llm.simhash import keep_first_of_groups
from driftlens.llm.suffix_dedup import drop_repeats
from driftlens.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_first_of_groups),
    ("repeated-substrings", drop_repeats),
    ("benchmark-leaks", drop_leaks),
    ("mix", mix_sources),
]

#: Neither the classifier nor the fingerprint search has a SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if k == len(STAGES) - 1 else materialize(made, f"stage-{name}")
    return docs
