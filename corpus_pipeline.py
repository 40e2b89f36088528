"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of docs; clashing or extra columns of the
input stay as they are. Stages work on all rows that their predecessor kept. Rows are told apart by doc_id and text
together, so null and repeated ids neither lose nor save a row:

- toxicity and decontamination judge each row by its own text alone;
- near duplicates keep of each group the row of smallest id (null last), of equal ids that of smallest text digest, of
  rows equal in both one; rows without words are in no group and stay all;
- personal data is replaced row by row; mixing returns a row for each row.

Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import release, saved, table
from scriptorium.llm.decontaminate import mark_contamination
from scriptorium.llm.mixing import mixed_counts
from scriptorium.llm.neardup import near_duplicates
from scriptorium.llm.pii import redact_pii
from scriptorium.llm.toxicity import score_toxicity

#: Words of a shingle in the stage for near duplicates.
SHINGLE_WORDS = 5


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """docs with names that clash with nothing, these names, and those of doc_id and text."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is toxic go."""
    release(spark)
    own, names, doc_id, text = renamed(docs)
    scored = score_toxicity(own, table(spark, sf_dir, "labels"), id_col=doc_id, text_col=text, keep=names)
    return scored.filter("predicted = 0").select(names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays; texts without words stay all."""
    release(spark)
    own, names, doc_id, text = renamed(docs)
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = own.withColumn("__key", key)
    worded = keyed.filter(has_words)
    kept = near_duplicates(worded.select("__key", text), "__key", text, SHINGLE_WORDS).filter("kept").select("__key").distinct()
    # equal rows meet before the join, which needs no further shuffle of texts
    out = worded.dropDuplicates(["__key"]).join(saved(kept, "kept"), "__key", "left_semi")
    return out.select(names).union(own.filter(~has_words)).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    release(spark)
    own, names, _, text = renamed(docs)
    marked = mark_contamination(own, table(spark, sf_dir, "benchmark"), text_col=text, keep=names)
    return marked.filter(F.size("hits") == 0).select(names).toDF(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text."""
    release(spark)
    out = redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: size, source_size, target and taken, in words."""
    release(spark)
    return mixed_counts(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("mixing", mix)]

#: Neither the scores nor the schedule can be expressed in SQL; the tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
