"""Vocabulary by document frequency, encoding and coverage."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: special tokens, first and in this order.
SPECIALS = ("[PAD]", "[CLS]", "[MASK]", "[UNK]", "[RARE_IMPORT]")
PAD, CLS, MASK, UNK, RARE_IMPORT = range(5)
IDENTITY = ["package", "decl_file", "name"]
FORMAT = 1


def document_frequency(rows: DataFrame) -> DataFrame:
    """(token, functions): how many identities use a token."""
    each = rows.select(*IDENTITY, F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    return each.groupBy("token").agg(F.count("*").alias("functions"))


def build_vocab(rows: DataFrame, min_functions: int = 5) -> DataFrame:
    """(id, token): specials, then tokens in enough functions, most frequent first.
    A vocabulary is bounded by its floor, so it is numbered in one task."""
    if min_functions < 1:
        raise ValueError(f"min_functions must be 1 or more, not {min_functions}")
    kept = document_frequency(rows).where((F.col("functions") >= min_functions) & ~F.col("token").isin(*SPECIALS))
    order = F.row_number().over(Window.orderBy(F.desc("functions"), "token"))
    special = rows.sparkSession.createDataFrame(list(enumerate(SPECIALS)), "id int, token string")
    return special.unionByName(kept.select((order + len(SPECIALS) - 1).alias("id"), "token"))


def encode(rows: DataFrame, vocab: DataFrame, key: str = "function_id") -> DataFrame:
    """(key, position, token, token_id): unknown imports and unknown others have ids of their own."""
    each = rows.select(key, F.posexplode("tokens").alias("position", "token"))
    known = each.join(vocab, "token", "left")
    fallback = F.when(F.col("token").startswith("IMPORT:"), F.lit(RARE_IMPORT)).otherwise(F.lit(UNK))
    return known.select(key, "position", "token", F.coalesce("id", fallback).alias("token_id"))


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """ids with their token; an id out of range is an error."""
    joined = ids.join(vocab.select(F.col("id").alias("token_id"), "token"), "token_id", "left")
    return joined.withColumn("token", F.coalesce("token", F.raise_error(F.concat(F.lit("no token has id "), F.col("token_id").cast("string")))))


def coverage(encoded: DataFrame, functions: DataFrame, key: str = "function_id") -> DataFrame:
    """One row: tokens, rates of the fallbacks and of functions with one."""
    per = encoded.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("token_id") == UNK).alias("unknown"), F.count_if(F.col("token_id") == RARE_IMPORT).alias("rare"))
    all_of = functions.select(key).join(per, key, "left").na.fill(0, ["n", "unknown", "rare"])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    touched = F.count_if(F.col("unknown") + F.col("rare") > 0)
    return all_of.agg(
        F.sum("n").alias("tokens"),
        rate(F.sum("unknown"), F.sum("n")).alias("unk_rate"),
        rate(F.sum("rare"), F.sum("n")).alias("rare_import_rate"),
        F.count("*").alias("functions"),
        rate(touched, F.count("*")).alias("functions_with_fallback"),
    )


def vocab_hash(vocab: DataFrame) -> DataFrame:
    """One row: 16 digits over the tokens in the order of their ids."""
    whole = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("v"))
    return whole.select(F.substring(F.sha2(F.array_join("v.token", "\n"), 256), 1, 16).alias("vocab_hash"))


def unigram_floor(train: DataFrame, val: DataFrame) -> DataFrame:
    """One row: cross-entropy of val tokens under add-one smoothed train counts; null without val tokens."""
    counts = lambda df, name: df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias(name))
    both = counts(train, "t").join(counts(val, "v"), "token", "full").na.fill(0, ["t", "v"])
    total = both.agg(F.sum("t").alias("all"), F.count("*").alias("kinds"))  # one row
    p = (F.col("t") + 1) / (F.col("all") + F.col("kinds"))
    return both.crossJoin(F.broadcast(total)).agg(F.try_divide(-F.sum(F.col("v") * F.log(p)), F.sum("v")).alias("nats"), F.sum("v").alias("tokens"), F.max("kinds").alias("kinds"))


def save(vocab: DataFrame, path: str, min_functions: int, source: dict) -> None:
    """A vocabulary as a JSON file on the driver; it is bounded by its floor."""
    tokens = [r["token"] for r in vocab.orderBy("id").collect()]
    Path(path).write_text(json.dumps({"format": FORMAT, "min_functions": min_functions, "source": source, "tokens": tokens}))


def load(spark, path: str) -> DataFrame:
    """A saved vocabulary; refuses another format, moved specials and repeated tokens."""
    found = json.loads(Path(path).read_text())
    tokens = found["tokens"]
    if found.get("format") != FORMAT:
        raise ValueError(f"format {found.get('format')} is not {FORMAT}")
    if tuple(tokens[: len(SPECIALS)]) != SPECIALS:
        raise ValueError("the special tokens do not come first")
    if len(set(tokens)) != len(tokens):
        raise ValueError("a token is there twice")
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string")


def with_cls(ids: Column, max_length: int) -> Column:
    """The start token and as many ids as fit behind it."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, max_length - 1))
