"""A corpus pipeline over ``documents``: each stage calls one operator of ``citeloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents``.  Where a stage drops rows, only their numbers are
gathered; Catalyst broadcasts them if their written size allows it and joins by
shuffle otherwise.  A row's number is its id where no other row has it; rows
without an id, or with one that repeats, are told apart by their texts, so that
decisions take effect on them, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import entropy_mix, piece_viterbi, ppm_language
from citeloom.llm.common import written
from citeloom.llm.content_sort import exact_dedup
from citeloom.llm.simhash import near_groups

#: Near-duplicates: a Jaccard similarity of NEAR_LEAST, counted over distinct shingles of five words.  Fingerprints of 256 bits
#: only choose what is counted: texts at 0.8 differ in 39 bits on average (deviation 6), those of four and five shingles in 48,
#: so NEAR_BITS for longer texts and NEAR_WIDE for short ones miss practically none.  They share one of NEAR_ANCHORS pairs of
#: shingles, but for four in a hundred thousand.
NEAR_WORDS, NEAR_LANES, NEAR_BITS, NEAR_WIDE, NEAR_ANCHORS, NEAR_LEAST = 5, 4, 68, 84, 10, 0.8
#: A text that the best language's model codes in no fewer bits than its bytes have is in none of the languages.
PLAIN_BITS = 8.0


ROW, DOC = "_row", "_doc"


def _numbered(docs: DataFrame) -> DataFrame:
    """ROW and DOC, the whole row as a struct, so that no column's name can clash; ROW is the id, or a hash of id and text, above all ids up to 2^62, for a null or repeated one; equal rows share it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(DOC))
    doc_id = F.col(DOC)["doc_id"]
    several = written(rows.groupBy(doc_id.alias("id")).agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select("id"))
    named = F.lit(1 << 62) + F.pmod(F.xxhash64(doc_id, F.coalesce(F.col(DOC)["text"], F.lit(""))), F.lit(1 << 61))
    row = F.when(doc_id.isNull() | F.col("id").isNotNull(), named).otherwise(doc_id.cast("long"))
    return rows.join(several, doc_id == F.col("id"), "left").select(row.alias(ROW), DOC)


def _texts(rows: DataFrame) -> DataFrame:
    """ROW and text, which is all that the operators read."""
    return rows.select(ROW, F.col(DOC)["text"].alias("text"))


def _without(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows without those whose number ``decided`` (ROW, stays) keeps none of."""
    dropped = decided.groupBy(ROW).agg(F.max(F.coalesce("stays", F.lit(False))).alias("stays")).filter("not stays").select(ROW)
    return rows.join(written(dropped), ROW, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = ppm_language.identify(_texts(rows), ppm_language.fit(docs), id_col=ROW)
    accepted = (F.col("lang_pred") != ppm_language.UNDETERMINED) & (F.col("bits_per_byte") < PLAIN_BITS)
    return _without(rows, found.select(F.col("doc_id").alias(ROW), accepted.alias("stays"))).select(f"{DOC}.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    decided = written(exact_dedup(_texts(rows), id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("kept").alias("stays")))
    kept = _without(rows, decided)
    # Rows that agree in id and text have one number: one of them stays.
    several = written(decided.groupBy(ROW).agg(F.count("*").alias("n"), F.max("stays").alias("stays")).filter("n > 1 and stays").select(ROW))
    one = kept.join(several, ROW, "left_semi").groupBy(ROW).agg(F.min_by(DOC, F.to_json(DOC)).alias(DOC))
    return kept.join(several, ROW, "left_anti").unionByName(one).select(f"{DOC}.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = near_groups(_texts(rows), NEAR_WORDS, NEAR_BITS, NEAR_LANES, NEAR_ANCHORS, id_col=ROW, least=NEAR_LEAST, wide=NEAR_WIDE)
    return _without(rows, groups.select(F.col("doc_id").alias(ROW), (F.col("doc_id") == F.col("component_id")).alias("stays"))).select(f"{DOC}.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_mix.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and the digest of the text that the ids decode to."""
    import public_tokenizers

    back = piece_viterbi.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("sentencepiece", sentencepiece)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
