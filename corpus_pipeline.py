"""The corpus pipeline: language ID, near-dedup, secret redaction, mixing and packing, in this order.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows before the next one reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import langid, minhash, mixing, packing, secrets
from panweave.llm._spark import Tables, read

#: The stage's law: five words, a similarity of 0.8 or more. A pair at 0.8 shares one of 25 buckets with probability
#: 1 - (1 - 0.8**5)**25 > 0.9999. (op2's own law is 0.85.)
NEAR = {"percent": 80, "width": 5, "bands": 25, "rows": 5}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier can't give a language (no text, no letter) go; the network's score rejects nothing.

    Null ids and repeated rows are judged like any other; extra columns stay; without labelled rows every document is
    without a language and goes.
    """
    columns = docs.columns
    found = langid.identify(docs, langid.train(docs), keep=tuple(columns))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, and of its texts in the group the smallest hash.

    Rows of one id are judged each by its own text, so unlike texts of one id all stay. Of rows that repeat id and text
    one stays, the first by its other columns as JSON. Null ids, which name no document, all stay; texts without a word
    are copies of nothing; extra columns stay.
    """
    tables = Tables(spark, "dedup")
    found = minhash.near_duplicates(docs, **NEAR).filter("doc_id IS NOT NULL")
    texts = tables.save(found.groupBy("doc_id", "text_hash").agg(F.min("group_id").alias("group_id"), F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    # only texts of a group's smallest id are joined by group, so a group of very many copies is no single task's work
    kept = texts.filter("kept")
    first = kept.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min("text_hash").alias("first"))
    heads = kept.join(first, "group_id", "left").withColumn("stays", F.coalesce(F.col("text_hash") == F.col("first"), F.lit(True)))
    marked = texts.filter("NOT kept").withColumn("stays", F.lit(False)).select("doc_id", "text_hash", "stays", "n").unionByName(heads.select("doc_id", "text_hash", "stays", "n"))
    per_id = marked.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all"), F.max("n").alias("n"))
    per_id = tables.save(per_id.filter("NOT some OR NOT all OR n > 1"))
    gone = tables.save(per_id.filter("NOT some").select(F.col("doc_id").alias("near_id")))
    split = per_id.filter("some").select("doc_id")
    # docs has the caller's column names, so the keys get names of their own
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("near_id"), F.xxhash64(F.col("text").cast("string")).alias("near_hash"))
    rows = rows.join(gone, "near_id", "left_anti")
    if split.isEmpty():
        return rows.select("row.*")
    # ids of which some rows stay, or one of repeated rows
    parts = tables.save(marked.join(split, "doc_id", "left_semi").filter("NOT stays OR n > 1"))
    key = (F.col("near_id") == F.col("doc_id")) & (F.col("near_hash") == F.col("text_hash"))
    once = rows.join(parts, key, "left_anti").select("row")
    again = rows.join(parts.filter("stays"), key, "left_semi").groupBy("near_id", "near_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(again.select("row")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; widely copied examples and all documents stay.

    A null text stays null; null ids and repeated rows are rows like any other; extra columns stay.
    """
    done = secrets.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it.

    Null and wordless texts are taken no time; a null source is a source of its own; repeated rows and rows of one id
    are documents of their own; ties in size go by the id's hash; extra columns stay.
    """
    return mixing.emit(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there.

    A null or empty text is its end id alone; null ids and repeated rows are packed like any other; extra columns go.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Trained weights and a tokenizer can't be written in SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs, held = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        out = tables.save(stage(spark, docs, sf_dir))
        if held is not None:
            tables.drop(held)
        docs = held = out
    return STAGES[-1][1](spark, docs, sf_dir)
