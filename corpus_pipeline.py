"""Corpus pipeline: language ID, near-duplicates, personal data, mixing and tokens, in that order over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import byte_bpe, language_id, mixing, pii, simhash
from turnloom.llm.common import free_name, table
from turnloom.scratch import cut, drop, step

#: Near-duplicates share most of their five-word shingles: the fingerprints have 4 x 64 bits, two texts are linked at
#: an angle of up to that of a cosine of 0.8 (52 of 256 bits). They meet in shards named by two min-hashes of 16 pairs.
SHINGLE, LANES, DISTANCE, ANCHORS = 5, 4, 52, 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Those without text or letters go, and those of some length that are
    further from every language's codeword than any labelled text by a margin. Without labelled documents all stay."""
    model = language_id.fit(docs, key=F.col("doc_id"))
    if not model.langs:
        return docs
    mark = free_name("said", docs.columns)
    said = docs.withColumn(mark, language_id.predict(F.col("text"), model))
    return said.where((F.col(mark)["lang"] != language_id.UNKNOWN) & ~F.col(mark)["foreign"]).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that with the smallest id, one without id last; of rows with that id in
    the group the one whose columns hash least, so a rerun keeps the same. Rows that share an id but not a group all stay.
    """
    mark = free_name("row", docs.columns)
    known = docs.withColumn(mark, F.xxhash64(*docs.columns))
    found = simhash.near_duplicates(known, words=SHINGLE, lanes=LANES, radius=DISTANCE, anchors=ANCHORS, row=F.col(mark))
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "row")).alias("f")
    keep = found.groupBy("group").agg(first).select(F.col("f.id").alias("id"), F.col("f.row").alias("row"))
    kept = known.join(keep, (known[mark] == keep["row"]) & known.doc_id.eqNullSafe(keep.id), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data and secrets; n_chars follows the new text. Null and empty texts stay."""
    mark, seen = free_name("done", docs.columns), free_name("entities", docs.columns)
    changed = {"text": F.col(mark)["text"]}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.col(mark)["text"]).cast(docs.schema["n_chars"].dataType)

    def replaced(again: dict) -> DataFrame:
        done = docs.withColumn(mark, pii.surrogates(F.col("text"), pii.session_key(spark), again))
        return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns], F.col(mark)["entities"].alias(seen))

    return pii.settled(replaced, seen).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets, in training order; a document taken twice is two rows. Null and empty texts have no words, so
    nothing of them is taken; rows without a source are a source of their own."""
    return mixing.training_stream(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text. A null or empty text has no ids; repeated rows stay."""
    coded = docs.select("doc_id", "source", "lang", byte_bpe.encode_checked(F.col("text")).alias("t"))
    return coded.select("doc_id", "source", "lang", F.floor(F.octet_length("t.ids") / 4).alias("n_tokens"), "t.ids", "t.round_trip")


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mix_sources", mix_stage),
    ("byte_bpe", token_stage),
]
#: Models, keyed replacements and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again. What a stage and the one before
    it have written goes once its own rows are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with step() as written:
            docs = cut(stage(spark, docs, sf_dir))
            written.remove(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
