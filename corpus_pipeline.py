"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Stages decide on rows, not on doc_ids: each row is carried whole, as a struct beside a number of its own, so
extra columns may have any name, and rows with a null or repeated doc_id are judged like any others.
Where one row of a group stays it is that of the least doc_id, nulls last; of rows that tie in it any one. Null
and blank texts have too few words for the quality rules; very long texts are handled whole in every
stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, ngram_jaccard, packing, quality_rules
from lodestone.llm.common import small, stored, table


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the rows of docs as structs, with numbers that hold: of files and of rows in them, if docs is read
    from files, so that the rows need not be stored once more; else as they are stored."""
    read = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if read and docs.inputFiles() and "_metadata" not in docs.columns:
        path, at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")
        # One row per file: the window over all of them holds the list of files, not documents.
        files = stored(docs.select(path).distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("file")), "files")
        rows = docs.select(path, at, F.struct("*").alias("doc")).join(small(files), "path")
        return rows.select((F.shiftleft(F.col("file").cast("long"), 40) + F.col("at")).alias("row"), "doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of the rows whose numbers are kept; few numbers are sent to the rows rather than rows to them."""
    return rows.join(small(stored(kept, "kept")), "row", "left_semi").select("doc.*")


def _first() -> Column:
    """Orders the rows of a group: the least doc_id, nulls last."""
    return F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("id"), F.col("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' current policy keeps."""
    return quality_rules.apply_policy(quality_rules.judged(docs, keep=True)).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text."""
    rows = _numbered(docs)
    kept = exact_dedup.groups(rows.select("row", "doc", F.col("doc.text").alias("text")), key=_first()).where("kept")
    return _only(rows, kept.select("doc_id.row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones; empty texts are linked with nothing and stay."""
    rows = _numbered(docs)
    groups = ngram_jaccard.join(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    ids = rows.select("row", _first().alias("first"))
    named = ids.join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    return _only(rows, named.groupBy("component_id").agg(F.min("first").alias("first")).select("first.row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once per epoch that takes words of it; a text the budget cuts keeps its first taken words."""
    rows = _numbered(docs)
    fields = rows.select("row", "doc", "doc.doc_id", "doc.text", "doc.source")
    taken = mixing.mix(fields, carry=("row",)).where("taken > 0").select("row", "size", "taken")
    turns = rows.join(taken, "row").withColumn("turn", F.explode(F.expr("sequence(0L, (taken - 1) DIV size)")))
    words = F.least("size", F.col("taken") - F.col("turn") * F.col("size"))
    trimmed = F.regexp_replace("doc.text", r"^[\x20\x09-\x0D]+", "")
    lead = F.concat_ws(" ", F.slice(F.split(trimmed, r"[\x20\x09-\x0D]+"), F.lit(1), words.cast("int")))
    whole = words == F.col("size")
    text = F.when(whole, F.col("doc.text")).otherwise(lead)
    out = turns.withColumn("doc", F.col("doc").withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("doc", F.col("doc").withField("n_chars", F.when(whole, F.col("doc.n_chars")).otherwise(F.length("doc.text").cast("long"))))
    return out.select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: Packing needs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
