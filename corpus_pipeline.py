"""A corpus pipeline over ``documents``: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, with the rows that they keep unchanged, further columns of any
name and type included. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ptclake.llm.common import discard, free_name, materialize, table, with_positions
from ptclake.llm.ngram_join import ngram_components
from ptclake.llm.packing import pack_documents
from ptclake.llm.quality_classifier import held_out, score, train
from ptclake.llm.quality_rules import RULES, text_statistics, verdict


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rule table; the projection stands beside the row, so nothing is joined.

    Null and empty texts have no words and go; rows without an id and repeated rows are judged each.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    judged = text_statistics(carried, carry="row")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.filter(~base & verdict(RULES)).select("row.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labelled rows of the whole table, held-out fold aside.

    Null and empty texts score by the intercept; without any label every score is 0.5 and all stay; rows without an id and repeated rows
    are scored each.
    """
    weights = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, weights, keep=0.5)


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a Parquet table with a number of their own, from 0, and its column: the rows of the files before (by path) and the place in the file.

    So numbers need no sort and are the same whenever the table is read; only a row per file is put in order. Frames that are
    no plain table are written first.
    """
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = materialize(docs, "pipeline-rows")
    place, key = docs.metadataColumn("_metadata"), free_name(docs, "number")
    path, start = free_name(docs, "path"), free_name(docs, "start")
    sizes = docs.select(place["file_path"].alias(path)).groupBy(path).count()
    files = materialize(with_positions(sizes, [path], weight="count", name="pipeline-files", start=start).select(path, start), "pipeline-files")
    # a row per file: Spark sends it to all tasks while it is small
    rows = docs.withColumns({path: place["file_path"], key: place["row_index"]}).join(files, path)
    return rows.withColumn(key, F.col(key) + F.col(start)).drop(path, start), key


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id (none counts as the largest; then the first row).

    A document is a row: rows that share an id, or have none, are told apart, and of them only near copies leave one.
    Texts without words are no copies of anything and all stay. Groups, ids and the choice are worked out on numbers; whole rows meet only the numbers that go.
    """
    rows, key = numbered_rows(docs)
    groups = ngram_components(rows.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    linked = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("of"), F.col("component_id").alias("group")), "pipeline-linked")
    members = linked.unionByName(linked.select(F.col("group").alias("of"), "group").distinct())
    ids = rows.select(F.col(key).alias("of"), F.col("doc_id").alias("id")).join(members, "of")
    stays = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "of")).alias("first")).select(F.col("first.of").alias("of"))
    # the rows that go are far fewer than those that stay: Spark may send them to all tasks instead of shuffling whole rows
    gone = materialize(members.join(stays, "of", "left_anti").select(F.col("of").alias("gone")), "pipeline-gone")
    return rows.join(gone, rows[key] == gone["gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens; null and empty texts are one piece with the end id."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, limit=4096)


STAGES = [("quality rules", rules_stage), ("quality classifier", classifier_stage), ("near duplicates", near_duplicates_stage), ("packing", packing_stage)]

#: Scores and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(*([before] if before is not None else []))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
