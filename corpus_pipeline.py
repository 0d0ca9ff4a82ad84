"""From raw documents to packed training batches: five stages, each a whole-corpus operator of lodestar.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mixing, packing, pii, quality, simhash
from lodestar.llm.common import Written, table

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the fitted quality model nor the rounding; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder before the next reads it.

    Null and empty texts end at the first stage. Rows without an id, and rows that share one, are documents of their own in every
    stage; of rows that agree in all columns one stays. Very long texts pass whole. Without documents, labels or both the result
    is empty or the rules alone decide. Columns beside doc_id, text and source may have any name and go along up to packing.
    """
    keep = Written(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
