"""A training corpus from raw documents: quality, line dedup, near duplicates, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import bpe, line_dedup, mixing, ngram_join, quality
from evidentia.llm.common import checkpointed, read, shared_folder
from evidentia.workers import ready


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names that no operator uses, so that extra columns cannot clash with theirs."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled rows among them.

    Null and empty texts are scored as empty ones, long texts as a whole; equal texts, repeated rows too, fare alike; a score of
    exactly 0.5 stays.  Without labels of both classes, and so with an empty label table, nothing goes; an empty table
    gives an empty table.  Extra columns pass through, whatever their names.
    """
    model = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"))
    plain, names = numbered(docs)
    kept = quality.score(plain, model, names["doc_id"], names["text"], keep=True).where("quality_score >= 0.5")
    return kept.select(*names.values()).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; a document that loses all its text goes with it.

    Null and empty texts stay as they are; lines of any length and texts of any number of lines are compared.  Of equal lines
    that of the smallest id stays (no id is last, ties by the row's text, then the line's number), so repeated rows, which
    count as one, keep it alike.  ``n_chars`` is set anew; extra columns pass through, whatever their names; an empty table
    gives an empty table.
    """
    ready(spark)
    plain, names = numbered(docs)
    text = names["text"]
    out = line_dedup.dedup_lines(plain, names["doc_id"], text).where((F.col("n_dropped") == 0) | (F.trim(text) != "")).select(*names.values())
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out.toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): that of the smallest id, ties by its text.

    A document is an id with its text, so of rows that share an id but not the text each counts for itself; of rows equal in
    both, one stays, that of the smallest hash of all columns, so that a rerun keeps the same.  Texts without words are
    near nothing and stay, null ones too; documents without an id stay; long texts are compared whole.  Extra columns pass
    through, whatever their names; an empty table gives an empty table.
    """
    ready(spark)
    plain, names = numbered(docs)
    key, text = names["doc_id"], names["text"]
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    marked = plain.where(F.col(key).isNotNull()).withColumn("row_key", row)
    groups = ngram_join.near_groups(marked.select("row_key", F.col(text).alias("text")), id_column="row_key")
    kept = checkpointed(groups.where(F.col("row_key") == F.col("component_id")).select("row_key").distinct())
    first = Window.partitionBy("row_key").orderBy(F.xxhash64(*names.values()))
    dealt = marked.repartition("row_key")  # once, for the join and the window
    same = dealt.join(kept, "row_key", "left_semi").withColumn("place_of_row", F.row_number().over(first)).where("place_of_row = 1")
    return same.select(*names.values()).unionByName(plain.where(F.col(key).isNull())).toDF(*docs.columns)


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to raked shares of source, language and topic (the targets of the mixing operator).

    Null source or language is a category of its own; a null, empty or blank text has no tokens and is drawn with its cell's
    probability; a long text is read whole and drawn like a short one.  The draw is a hash of the id (of the text, without an
    id), so repeated rows fare alike and a rerun draws the same.  Targets that these documents cannot meet are met as far as
    they can, under a warning.  Extra columns pass through, whatever their names; an empty table gives an empty table.
    """
    ready(spark)
    plain, names = numbered(docs)
    mixed = mixing.mix(plain, mixing.TARGETS, mixing.KEEP, strict=False, id_column=names["doc_id"], text=names["text"], source=names["source"], lang=names["lang"])
    return mixed.where("mix_sampled = 1").select(*names.values()).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, with digests of the ids and of what they decode to.

    One row a row, repeated ones too; a null text is encoded as an empty one, which has no ids; a long text is encoded
    whole.  Extra columns are left out; an empty table gives an empty table.
    """
    ready(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).drop("decoded")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", sample_to_targets),
    ("bpe", token_ids),
]

#: A trained classifier and byte-level BPE have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
