"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's documents.  All but the last return the columns of documents:

1. language: documents without a letter, whose language is unknown, go;
2. near_duplicates: of each group of documents that are linked by five-word
   shingles at a Jaccard similarity of 0.8 or more, the smallest doc_id stays;
3. secrets: every secret found is replaced by a mark, n_chars is counted anew;
4. mixing: documents are repeated or left out so that sources meet their targets;
5. packing: a row per piece of a document with its place in a packed sequence.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further
columns are handled as the operators' modules say.
"""

from __future__ import annotations

from docgauge.llm import language, mixing, packing, secrets, shingles
from docgauge.llm.common import written


def by_language(spark, docs, sf_dir):
    return language.known_language(docs)


def near_duplicates(spark, docs, sf_dir):
    return shingles.one_of_each(docs)


def without_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def mixed(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def packed(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("language", by_language), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the filters, the field or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
