"""The corpus pipeline: five stages over documents, each by one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the docs of the next. All but the last
return the columns of documents, and a stage's decisions take effect in them: a
document that is rejected goes, a line that is dropped is no longer in its text
(and n_chars, where it is a column, is that of the new text).

SQL cannot express the first stage, so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, langid, linededup, packing, partenum
from quernstone.llm.common import only, own_prefix, stored, table

#: A document whose language the network is less sure of than this is rejected, as
#: is one without letters. Four languages by chance would have a quarter each.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    p = own_prefix(docs)
    found = langid.predict(docs, langid.fit(docs), p)
    return found.where((F.col(f"{p}lang_pred") != langid.UNKNOWN) & (F.col(f"{p}score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; none goes, some get shorter."""
    p = own_prefix(docs)
    kept = F.when(F.col("text").isNotNull(), F.col(f"{p}kept"))
    new = {"text": kept} | ({"n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return linededup.drop_repeated_lines(docs, p).withColumns(new).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least id; rows without an id stay."""
    found = stored(partenum.near_duplicates(docs), "near-duplicates")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return only(docs, gone, keep=False)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    p = own_prefix(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), p)
    return found.where(~F.col(f"{p}contaminated")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("sequences", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
