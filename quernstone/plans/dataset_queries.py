"""Queries of dataset construction, over the function rows of bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.listing import content_key
from quernstone.operators import dataset
from quernstone.plans.bindings import MIN_INSTRUCTIONS, fn, table
from quernstone.plans.catalogue import query


_kept: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _keep(spark: SparkSession, name: str, d: str, rows: DataFrame) -> DataFrame:
    """rows persisted; a session holds those of one folder at a time. Spark recomputes
    what an executor loses, and spills what memory cannot hold."""
    key = (spark.sparkContext.applicationId, name)
    if key in _kept and _kept[key][0] != d:
        _kept.pop(key)[1].unpersist()
    _kept[key] = (d, rows.persist())
    return rows


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Kept once computed: tokens and content feed most queries, several times each."""
    return _keep(spark, "candidates", d, dataset.candidate_rows(fn(spark, d), MIN_INSTRUCTIONS).withColumn("content", content_key(F.col("tokens"))))


def eligible(spark: SparkSession, d: str) -> DataFrame:
    return _keep(spark, "eligible", d, dataset.eligible_rows(candidates(spark, d)))


def fixed_splits(rows: DataFrame) -> DataFrame:
    """A split by the name's length, for queries that SQL repeats."""
    k = F.length("package") % 3
    return rows.select("package").distinct().select("package", F.when(k == 0, "train").when(k == 1, "val").otherwise("test").alias("split"))


FIXED = "SELECT DISTINCT package, CASE length(package) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM fn"


@query("source_files", "SELECT * FROM source_files", "source_files")
def source_files(spark, d):
    return dataset.source_files(fn(spark, d))


@query("excluded_files", "SELECT * FROM excluded_files", "excluded_files")
def excluded_files(spark, d):
    return dataset.excluded_files(fn(spark, d))


@query("candidate_rows", "SELECT function_id, package, decl_file, name, opt_level, n_instructions FROM candidate", "candidate")
def candidate_rows(spark, d):
    return candidates(spark, d).select("function_id", "package", "decl_file", "name", "opt_level", "n_instructions")


@query("content_key", "SELECT function_id, content FROM candidate", "candidate")
def content_keys(spark, d):
    return candidates(spark, d).select("function_id", "content")


@query("duplicate_keys", "SELECT * FROM duplicate_key", "duplicate_key")
def duplicate_keys(spark, d):
    return dataset.duplicate_keys(candidates(spark, d))


@query("eligible_rows", "SELECT function_id, package, opt_level, content FROM eligible", "eligible")
def eligible_rows(spark, d):
    return eligible(spark, d).select("function_id", "package", "opt_level", "content")


@query("package_sizes", "SELECT package, count(*) AS functions FROM eligible GROUP BY package", "eligible")
def package_sizes(spark, d):
    return dataset.package_sizes(eligible(spark, d))


def _fold(domain: str) -> str:
    """The greedy fold as a recursion over the packages, in the order of their placement."""
    owed = lambda x: f"CASE WHEN members = 1 THEN 0 WHEN members = 2 THEN {int(x == 'test')} ELSE greatest(1, round_even(members * 0.15, 0)) END"  # noqa: E731 - the larger name gives way
    begin = lambda new, old: f"CASE WHEN nth = 0 THEN {new} ELSE {old} END"
    gap = lambda s, share: f"({share} * everything - g{s})"
    own = lambda s, share: f"({share} * total - l{s})"
    return f"""WITH RECURSIVE size AS (SELECT package, {domain} AS domain, count(*) AS n FROM eligible GROUP BY ALL),
    seq AS (SELECT *, row_number() OVER (ORDER BY domain, n DESC, package) AS i, row_number() OVER (PARTITION BY domain ORDER BY n DESC, package) - 1 AS nth, count(*) OVER (PARTITION BY domain) AS members,
      sum(n) OVER (PARTITION BY domain) AS total, sum(n) OVER (ORDER BY domain) AS everything FROM size),
    fold AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS package, NULL::VARCHAR AS split, 0::BIGINT AS lr, 0::BIGINT AS lv, 0::BIGINT AS lt, 0::BIGINT AS gr, 0::BIGINT AS gv, 0::BIGINT AS gt, 0::BIGINT AS ov, 0::BIGINT AS ot
      UNION ALL SELECT i, package, split, lr + CASE split WHEN 'train' THEN n ELSE 0 END, lv + CASE split WHEN 'val' THEN n ELSE 0 END, lt + CASE split WHEN 'test' THEN n ELSE 0 END,
        gr + CASE split WHEN 'train' THEN n ELSE 0 END, gv + CASE split WHEN 'val' THEN n ELSE 0 END, gt + CASE split WHEN 'test' THEN n ELSE 0 END, greatest(ov - (split = 'val')::INT, 0), greatest(ot - (split = 'test')::INT, 0)
      FROM (SELECT *, CASE WHEN ov + ot > 0 AND members - nth <= ov + ot THEN CASE WHEN ot = 0 OR ov > 0 AND {gap("v", 0.15)} >= {gap("t", 0.15)} THEN 'val' ELSE 'test' END
          WHEN {own("r", 0.7)} >= {own("v", 0.15)} AND {own("r", 0.7)} >= {own("t", 0.15)} THEN 'train' WHEN {own("v", 0.15)} >= {own("t", 0.15)} THEN 'val' ELSE 'test' END AS split
        FROM (SELECT seq.i, seq.package, n, nth, members, total, everything, {begin("0", "lr")} AS lr, {begin("0", "lv")} AS lv, {begin("0", "lt")} AS lt, gr, gv, gt, {begin(owed("val"), "ov")}::BIGINT AS ov, {begin(owed("test"), "ot")}::BIGINT AS ot
          FROM fold JOIN seq ON seq.i = fold.i + 1)))
    SELECT package, split FROM fold WHERE package IS NOT NULL"""


@query("assign_splits", _fold("''"), "eligible")
def assign_splits(spark, d):
    return dataset.assign_splits(dataset.package_sizes(eligible(spark, d)))


@query("assign_splits_by_domain", _fold("domain"), "eligible")
def assign_splits_by_domain(spark, d):
    rows = eligible(spark, d)
    return dataset.assign_splits(dataset.package_sizes(rows), rows.select("package", "domain"))


@query(
    "cross_split_collisions",
    f"""WITH s AS ({FIXED}) SELECT content, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, count(*) AS n_rows
    FROM candidate JOIN s USING (package) GROUP BY content HAVING count(DISTINCT split) > 1""",
    "candidate",
)
def cross_split_collisions(spark, d):
    rows = candidates(spark, d)
    out = dataset.cross_split_collisions(rows.join(F.broadcast(fixed_splits(rows)), "package"))
    return out.select("content", F.array_join("splits", ",").alias("splits"), F.array_join("packages", ",").alias("packages"), "n_rows")


@query(
    "leakage",
    f"""WITH s AS ({FIXED}) SELECT
    (SELECT count(*) FROM (SELECT content FROM candidate JOIN s USING (package) GROUP BY content HAVING count(DISTINCT split) > 1)) AS prevented,
    (SELECT count(*) FROM (SELECT content FROM eligible JOIN s USING (package) GROUP BY content HAVING count(DISTINCT split) > 1)) AS leaked""",
    "candidate",
    "eligible",
)
def leakage(spark, d):
    rows = candidates(spark, d)
    return dataset.leakage(rows, fixed_splits(rows))


@query(
    "vendored_copies",
    """WITH p AS (SELECT DISTINCT content, package FROM candidate),
    f AS (SELECT content FROM p GROUP BY content HAVING count(*) BETWEEN 2 AND 3)
    SELECT a.package AS first_package, b.package AS second_package, count(*) AS shared
    FROM p a JOIN p b USING (content) JOIN f USING (content) WHERE a.package < b.package GROUP BY ALL HAVING count(*) > 0""",
    "candidate",
)
def vendored_copies(spark, d):
    return dataset.vendored_copies(candidates(spark, d), floor=0)


@query(
    "dataset_report",
    f"""WITH s AS ({FIXED}) SELECT 'functions' AS measure, count(*) AS value FROM fn
    UNION ALL SELECT 'excluded_files', count(*) FROM excluded_files UNION ALL SELECT 'candidates', count(*) FROM candidate
    UNION ALL SELECT 'duplicate_keys', count(*) FROM duplicate_key UNION ALL SELECT 'eligible', count(*) FROM eligible
    UNION ALL SELECT 'split_' || split, count(*) FROM eligible JOIN s USING (package) GROUP BY split""",
    "eligible",
)
def dataset_report(spark, d):
    rows = fn(spark, d)
    return dataset.report(rows, candidates(spark, d), eligible(spark, d), fixed_splits(rows))


@query(
    "dataset_fingerprint",
    f"""WITH s AS ({FIXED}), c AS (SELECT package, count(*) AS n FROM eligible GROUP BY package)
    SELECT substr(sha256('[' || string_agg('["' || package || '","' || coalesce(split, '-') || '",' || n || ']', ',' ORDER BY package) || ']'), 1, 16) AS fingerprint
    FROM c LEFT JOIN s USING (package)""",
    "eligible",
)
def dataset_fingerprint(spark, d):
    rows = eligible(spark, d)
    return dataset.fingerprint(rows, fixed_splits(rows))


@query(
    "row_digest",
    """WITH h AS (SELECT sha256(concat_ws(chr(9), function_id::VARCHAR, package, opt_level, content)) AS h FROM eligible),
    p AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1)
    SELECT sha256(string_agg(b || d, chr(10) ORDER BY b || d)) AS digest FROM p""",
    "eligible",
)
def row_digest(spark, d):
    return dataset.row_digest(eligible(spark, d), "function_id", "package", "opt_level", "content")


@query(
    "paths_outside_group",
    """WITH c AS (SELECT package, decl_file, count(*) AS n_rows FROM fn WHERE decl_file IS NOT NULL AND NOT starts_with(decl_file, '/work/' || package || '/') GROUP BY ALL)
    SELECT *, (row_number() OVER (PARTITION BY package ORDER BY n_rows DESC, decl_file))::INT AS place FROM c QUALIFY place <= 5""",
    "fn",
)
def paths_outside_group(spark, d):
    return dataset.paths_outside_group(fn(spark, d), F.concat(F.lit("/work/"), F.col("package"), F.lit("/")))


@query(
    "content_dedup_documents",
    "SELECT sha256(text) AS content, count(DISTINCT source) AS packages, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
)
def content_dedup_documents(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content"), F.col("source").alias("package"))
    return dataset.duplicate_keys(docs)


