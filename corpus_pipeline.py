"""Corpus pipeline: documents through language ID, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns documents again; the last
returns the pieces of the packed sequences. `run` writes each stage's rows as Parquet and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shizuku.llm import langid, linededup, mixing, neardup, packing
from shizuku.llm.common import crc_of, dropped, read, saved, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Piece tokenizer of the last stage; its file is part of the environment.
TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined, those without a letter, go; all others get the language that was found as their `lang`."""
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out), "text", "lang", "doc_id")
    found = langid.identify(docs.select(*COLUMNS, F.col("text").alias("__judged")), model, text_col="__judged")
    return found.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; every document stays, n_chars follows its text."""
    clean = linededup.dedup(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id, null last; of rows with one id, that with the smaller hash; of equal rows, one."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    named = docs.select(*COLUMNS).withColumn("__key", key)
    found = saved(neardup.near_duplicates(named, id_col="__key", width=5, percent=80).select(F.col("doc_id").alias("k"), "n_shingles", "kept"), "judged")
    gone = saved(found.filter(~F.col("kept")).select(F.col("k").alias("__gone")).distinct(), "gone")
    rest = named.join(small(gone), F.col("__key").eqNullSafe(F.col("__gone")), "left_anti")
    equal = saved(found.filter("kept AND n_shingles > 0").groupBy("k").count().filter("count > 1").select(F.col("k").alias("__twice")), "equal-rows")
    if equal.limit(1).count():
        twice = rest.join(small(equal), F.col("__key").eqNullSafe(F.col("__twice")), "left_semi").dropDuplicates(["__key"])
        rest = rest.join(small(equal), F.col("__key").eqNullSafe(F.col("__twice")), "left_anti").unionByName(twice)
    return rest.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is repeated as often as its source's target takes it, and left out where it doesn't."""
    taken = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies"))
    taken = saved(taken, "mix")
    named = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (mixing.size_of(F.col("text")) == F.col("__size"))
    copies = docs.join(small(named), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*before)  # the stage that read it is saved
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
