"""The thin queries of the ten operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, fingerprint, htmltext, langid, linededup, packing, partenum, quality, secrets, tokencount
from quernstone.llm.common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), keep_text=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: x == F.lit(r.kind)), False)).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES]
    # the ledger adds no spans of its own: the base ones are all
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = quality.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    return quality.score(docs, machine, keep_text=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = langid.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    return langid.predict(docs, net, keep_text=False)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(documents(spark, sf_dir), keep_text=False)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontaminate,
        op3_fingerprints,
        op4_best_fit_packing,
        op5_secret_scan,
        op6_ngram_jaccard,
        op7_quality,
        op8_language_id,
        op9_line_dedup,
        op10_html_text,
    )
}
