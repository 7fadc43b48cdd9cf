"""The corpus pipeline: from documents to encoded documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  A stage reads what its predecessor wrote.

Every stage treats odd rows as its operator states.  In short: null texts count as
empty; an empty text is never toxic, is an exact copy of other empty texts, and has no
near copies; rows with a null doc_id pass both removals of copies, as no decision can
name them; repeated rows share each decision; a null source is a source of its own; an
empty table gives an empty result, and without labels of both classes nothing is
rejected.  Further columns of documents are carried to the last stage, whatever
their names, which returns doc_id, source and the encoded document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.bpe import encode_table
from corpuscle.llm.common import cut, table
from corpuscle.llm.exact_dedup import drop_copies
from corpuscle.llm.mixing import mix
from corpuscle.llm.ngram_join import drop_near_copies
from corpuscle.llm.queries import tokenizer_path
from corpuscle.llm.toxicity import reject_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go."""
    return reject_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the smallest doc_id of each component stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once, those of small sources up to twice."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the encoded document's length and digests."""
    return encode_table(docs, tokenizer_path(spark), keep=("source",))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: A trained model, a transitive closure and a tokenizer are beyond SQL; tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each from the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
