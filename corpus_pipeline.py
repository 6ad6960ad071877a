"""The corpus pipeline: filter, deduplicate, decontaminate and encode documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of documents. Between stages the rows are written to the shared
folder and read again, so a lost executor costs at most one stage; they go when the next stage's are there.

Defined cases: rows with a null id or text and empty texts go on as they are, unless line dedup empties a text or near-dedup keeps
another row; of repeated rows near-dedup keeps one. Without labels no document is toxic, without benchmark items none is contaminated; an empty table gives
no rows. Texts of any length are taken whole. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import materialize
from textloom.llm.decontamination import drop_contaminated
from textloom.llm.lines import drop_lines
from textloom.llm.neardup import keep_one
from textloom.llm.pieces import encode_stage
from textloom.llm.toxicity import keep_clean
from textloom.scratch import drop

STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", keep_one),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: Learned and approximate stages have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
            if number > 1:
                drop(before)
    return docs
