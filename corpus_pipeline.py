"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from placelens.llm import decontamination, line_dedup, ngram_join, pieces, toxicity
from placelens.llm.common import broadcast_if_small, stage, table
from pyspark.sql import functions as F


def drop_toxic(spark, docs, sf_dir):
    """Documents that the ordinal model, fitted on the labelled ones among `docs`, finds toxic go."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark, docs, sf_dir):
    """Of similar lines in the whole corpus the first stays; documents of which no line stays go."""
    kept = line_dedup.dedup_lines(docs).where("__lines = 0 OR __kept > 0")
    changed = F.col("__kept") < F.col("__lines")
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """Of documents connected by a Jaccard similarity of five-word shingles of 0.8 or more, the smallest id stays."""
    classes = ngram_join.ngram_join(docs, n=5, num=80, den=100)
    others, _ = stage(classes.where("doc_id != component_id").select("doc_id").distinct(), "duplicates")
    return docs.join(broadcast_if_small(others), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Documents that overlap with an item of the benchmark go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """The remaining documents as piece ids."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: The learned model, the hashed bands and the Viterbi search have no SQL form; tests/llm/ compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs, _ = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
