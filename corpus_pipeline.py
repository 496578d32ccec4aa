"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), calls one operator of
``retail_signal.llm`` on all that its predecessor kept, and returns a
DataFrame, which ``run`` writes as Parquet to the shared folder and reads back.
All stages but the last return the columns of ``documents``:

1. quality: the positive-unlabelled classifier; rejected documents go;
2. near_duplicates: SimHash components; the document of the least id stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: sources to their target weights; a document may come twice;
5. token_records: length-delimited files of token ids, read back.

Defined results: nulls, empty and repeated rows as each operator states;
an empty table passes through all stages; columns beyond those of
``documents`` pass through stages 1 to 4 untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_signal.llm import decontam, mixing, quality, records, simhash
from retail_signal.llm.common import crc_fold, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fitting = crc_fold("doc_id", quality.FOLDS) != quality.HELD
    return quality.accepted(docs, table(spark, sf_dir, "labels"), fitting, cutoff=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, width=4, radius=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return records.encode_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_records", token_stage),
]

#: A classifier is not expressible in SQL; tests/llm holds a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
