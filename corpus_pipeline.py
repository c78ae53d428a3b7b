"""The corpus pipeline: quality, lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, with n_chars the length of the text that is
left. ``run`` writes each stage's result as Parquet and reads it for the next.

Nulls: a row with a null id passes the deduplicating stages unchanged; a null
text scores as an empty one. A document of which a deduplicating stage leaves no
word is left out. Rows with the same id and text are one document; each other
text of an id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import keep, left_join_few, read
from tidepanel.llm.lines import line_tag, removed_lines
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.probminhash import near_duplicates, one_of_each
from tidepanel.llm.quality import fit_quality, held_out, score_column
from tidepanel.llm.substrings import remove_repeats


def _names(docs: DataFrame) -> tuple[str, str]:
    """Names for a document's new text and its text's tag that no column has."""
    longest = max(docs.columns, key=len, default="")
    return f"{longest}_new", f"{longest}_tag"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3; labels are learned as in the quality query."""
    model = fit_quality(docs.where(~held_out()), read(spark, sf_dir, "labels"))
    return docs.where(score_column(model) >= 0.3)


def _with_text(docs: DataFrame, new: str) -> DataFrame:
    """The new text takes the old one's place where there is one; documents left without a word go."""
    changed = F.col(new).isNotNull()
    rest = docs.where(~changed | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return rest.withColumns({"n_chars": F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType), "text": F.coalesce(new, "text")}).drop(new)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new, tag = _names(docs)
    gone = removed_lines(docs).withColumnsRenamed({"removed": new, "tag": tag})
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), new)
    text = F.when(F.col(new).isNotNull(), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return _with_text(left_join_few(docs.withColumn(tag, line_tag()), gone, ["doc_id", tag]).withColumn(new, text), new).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, near_duplicates(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new, tag = _names(docs)
    changed = remove_repeats(docs).where("n_removed > 0").select("doc_id", F.col("tag").alias(tag), F.col("text").alias(new)).dropDuplicates(["doc_id", tag])
    return _with_text(left_join_few(docs.withColumn(tag, F.xxhash64("text")), keep(changed, "changed"), ["doc_id", tag]), new).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages' learned scores, sketches and edit distances are not SQL; tests hold what the stages do to planted documents against their whole expected rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
