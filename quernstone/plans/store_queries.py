"""Queries of the store, its checks and the corpus.

The tables of the store are made of the driver's tables with known faults in them:
rows hidden or moved by remainders of their ids, alike in Spark and in SQL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.picks import seeded_order
from quernstone.operators.browse import find_functions as find
from quernstone.operators import checks, store
from quernstone.plans.bindings import NEEDS, SQL, corpus, event_log, fn, places, table
from quernstone.plans.catalogue import query
from quernstone.plans.dataset_queries import eligible
from quernstone.sources import migrations, snapshots

NOW = datetime.datetime(1998, 8, 2)
RUN_KINDS = ["scan", "train", "baselines"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "ok").otherwise("failed")
    kind = F.element_at(F.array(*map(F.lit, RUN_KINDS)), (F.col("o_orderkey") % 3).cast("int") + 1)
    return o.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.concat(F.lit("v"), (F.col("o_custkey") % 5).cast("string")).alias("code_version"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    part, e = table(spark, d, "part"), event_log(spark, d)
    order = Window.partitionBy("binary_id").orderBy("ts", "event_id")
    numbered = e.withColumn("seq", F.row_number().over(order).cast("long")).where("event_id % 501 <> 7")
    events = numbered.select(F.col("event_id").alias("id"), "binary_id", (F.col("event_id") % 2000).alias("run_id"), (F.col("seq") - F.when(F.col("event_id") % 1013 == 5, 1).otherwise(0)).alias("seq"))
    kind = F.when(F.col("event_id") % 250 == 3, "mystery").otherwise("function")
    links = e.select("event_id", kind.alias("entity_kind"), (F.col("event_id") * 7 % 2500).alias("entity_id"), F.lit("subject").alias("role"))
    external = F.col("p_partkey") % 10 == 0
    functions = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("binary_id"), (F.col("p_partkey") * 16).alias("address"), external.alias("is_external"), F.when(external, F.col("p_brand")).alias("library"), F.col("p_name").alias("raw_name"))
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    code = part.where("p_partkey % 10 <> 0").select((key + F.when(key % 97 == 1, 1_000_000).otherwise(0)).alias("function_id"), (size + F.when(key % 101 == 2, 1).otherwise(0)).alias("binary_id"))
    truth = part.select(key.alias("id"), (size + F.when(key % 103 == 3, 1).otherwise(0)).alias("binary_id"), key.alias("function_id"), (key * 16 + F.when(key % 11 == 4, 8).otherwise(0)).alias("address"))
    linked = store.link_twins(corpus(spark, d))
    twin = F.when(F.col("binary_id") % 127 == 5, F.lit(-1).cast("long")).when(F.col("binary_id") % 113 == 4, F.col("binary_id")).otherwise(F.col("twin_id"))
    binaries = linked.withColumn("twin_id", twin)
    packages = places(spark, d).select("package", F.lit("train").alias("split")).unionByName(spark.createDataFrame([("ATLANTIS", "test")], "package string, split string"))
    m = F.col("o_orderkey")
    run_id = m + F.when(m % 211 == 0, 1_000_000_000).otherwise(0)
    said = m + F.when(m % 97 == 0, 1).otherwise(0)
    method = F.when(m % 4 == 0, F.concat(F.lit("encoder-"), said.cast("string"))).when(m % 4 == 1, F.concat(F.lit("encoder-"), said.cast("string"), F.lit("-start"))).when(m % 4 == 2, F.concat(F.lit("encoder (run "), said.cast("string"), F.lit(")"))).otherwise("bm25")
    measurements = table(spark, d, "orders").select(m.alias("id"), run_id.alias("run_id"), method.alias("method"), F.col("o_totalprice").alias("value"))
    gaps = places(spark, d).where("n_nationkey % 4 = 1").select("package", F.concat(F.lit("O"), (F.col("n_nationkey") % 4).cast("string")).alias("opt_level"))
    return {"runs": runs(spark, d), "events": events, "event_links": links, "functions": functions, "function_code": code, "ground_truth": truth, "corpus_binaries": binaries, "dataset_split": packages, "measurements": measurements, "corpus_gaps": gaps}


SQL |= {
    "runs": "SELECT o_orderkey AS id, ['scan', 'train', 'baselines'][(o_orderkey % 3 + 1)::INT] AS kind, 'v' || (o_custkey % 5) AS code_version, o_orderdate AS started_at, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'failed' END AS status FROM orders",
    "numbered": "SELECT event_id, user_id AS binary_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    "log": "SELECT event_id AS id, binary_id, event_id % 2000 AS run_id, seq - CASE WHEN event_id % 1013 = 5 THEN 1 ELSE 0 END AS seq FROM numbered WHERE event_id % 501 <> 7",
    "links": "SELECT event_id, CASE WHEN event_id % 250 = 3 THEN 'mystery' ELSE 'function' END AS entity_kind, event_id * 7 % 2500 AS entity_id, 'subject' AS role FROM events",
    "functions": "SELECT p_partkey AS id, p_size::BIGINT AS binary_id, p_partkey * 16 AS address, p_partkey % 10 = 0 AS is_external, CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS library, p_name AS raw_name FROM part",
    "code": "SELECT p_partkey + CASE WHEN p_partkey % 97 = 1 THEN 1000000 ELSE 0 END AS function_id, p_size::BIGINT + CASE WHEN p_partkey % 101 = 2 THEN 1 ELSE 0 END AS binary_id FROM part WHERE p_partkey % 10 <> 0",
    "truth": "SELECT p_partkey AS id, p_size::BIGINT + CASE WHEN p_partkey % 103 = 3 THEN 1 ELSE 0 END AS binary_id, p_partkey AS function_id, p_partkey * 16 + CASE WHEN p_partkey % 11 = 4 THEN 8 ELSE 0 END AS address FROM part",
    "linked": "SELECT c.*, t.twin_id FROM corpus c LEFT JOIN (SELECT package, owner, opt_level, NOT stripped AS stripped, min(binary_id) AS twin_id FROM corpus GROUP BY package, owner, opt_level, corpus.stripped) t USING (package, owner, opt_level, stripped)",
    "bins": "SELECT * REPLACE (CASE WHEN binary_id % 127 = 5 THEN -1 WHEN binary_id % 113 = 4 THEN binary_id ELSE twin_id END AS twin_id) FROM linked",
    "splits": "SELECT package, 'train' AS split FROM places UNION ALL SELECT 'ATLANTIS', 'test'",
    "meas": "SELECT o_orderkey AS id, o_orderkey + CASE WHEN o_orderkey % 211 = 0 THEN 1000000000 ELSE 0 END AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'encoder-' || said WHEN 1 THEN 'encoder-' || said || '-start' WHEN 2 THEN 'encoder (run ' || said || ')' ELSE 'bm25' END AS method FROM (SELECT *, o_orderkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS said FROM orders)",
    "gaps": "SELECT package, 'O' || (n_nationkey % 4) AS opt_level FROM places WHERE n_nationkey % 4 = 1",
    "levels": "SELECT package, opt_level FROM corpus GROUP BY ALL HAVING count(DISTINCT stripped) = 2",
    "expected": "SELECT package, unnest(['O0', 'O1', 'O2', 'O3']) AS opt_level FROM (SELECT DISTINCT package FROM corpus)",
}
NEEDS |= {"log": ["numbered"], "linked": ["corpus"], "bins": ["linked"], "splits": ["places"], "gaps": ["places"], "levels": ["corpus"], "expected": ["corpus"]}

CHECK_SQL = {
    "dangling_links": ("SELECT event_id::VARCHAR AS subject, concat_ws(' ', entity_kind, entity_id, role) AS detail FROM links WHERE entity_kind <> 'function' OR entity_id NOT IN (SELECT id FROM functions)", ["links", "functions"]),
    "orphan_events": ("SELECT log.id::VARCHAR AS subject, concat_ws(' ', run_id, kind) AS detail FROM log JOIN runs ON run_id = runs.id WHERE status = 'running'", ["log", "runs"]),
    "seq_gaps": ("SELECT binary_id::VARCHAR AS subject, concat_ws(' ', min(place), arg_min(seq, place)) AS detail FROM (SELECT binary_id, seq, row_number() OVER (PARTITION BY binary_id ORDER BY seq) AS place FROM log) WHERE place <> seq GROUP BY binary_id", ["log"]),
    "unfinished_runs": ("SELECT id::VARCHAR AS subject, kind AS detail FROM runs WHERE status = 'running'", ["runs"]),
    "code_orphans": ("SELECT function_id::VARCHAR AS subject, concat_ws(' ', code.binary_id, coalesce(f.binary_id::VARCHAR, 'none')) AS detail FROM code LEFT JOIN functions f ON f.id = function_id WHERE f.id IS NULL OR f.binary_id <> code.binary_id", ["code", "functions"]),
    "truth_binding": ("SELECT t.id::VARCHAR AS subject, concat_ws(' ', t.binary_id, f.binary_id) AS detail FROM truth t JOIN functions f ON f.id = function_id WHERE f.binary_id <> t.binary_id", ["truth", "functions"]),
    "twin_links": ("SELECT b.binary_id::VARCHAR AS subject, CASE WHEN t.binary_id IS NULL THEN 'twin missing' ELSE 'twin on the same side' END AS detail FROM bins b LEFT JOIN bins t ON t.binary_id = b.twin_id WHERE b.twin_id IS NOT NULL AND (t.binary_id IS NULL OR t.stripped = b.stripped)", ["bins"]),
    "split_groups": ("SELECT package AS subject, split AS detail FROM splits WHERE package NOT IN (SELECT package FROM bins)", ["splits", "bins"]),
    "measurement_runs": ("SELECT m.id::VARCHAR AS subject, method AS detail FROM meas m LEFT JOIN runs r ON r.id = run_id WHERE r.id IS NULL", ["meas", "runs"]),
    "measurement_names": (
        "SELECT m.id::VARCHAR AS subject, concat_ws(' ', run_id, method) AS detail FROM meas m WHERE (regexp_matches(method, '^encoder-[0-9]+(-start)?$') AND regexp_extract(method, '[0-9]+') <> run_id::VARCHAR) OR (regexp_matches(method, '^encoder \\(run [0-9]+\\)$') AND regexp_extract(method, '[0-9]+')::BIGINT NOT IN (SELECT id FROM runs WHERE kind = 'train'))",
        ["meas", "runs"],
    ),
    "duplicates": ("SELECT package AS subject, concat_ws(' ', opt_level, stripped, count(*)) AS detail FROM bins GROUP BY package, opt_level, stripped HAVING count(*) > 1", ["bins"]),
    "completeness": ("SELECT package AS subject, string_agg(opt_level, ' ' ORDER BY opt_level) AS detail FROM expected WHERE (package, opt_level) NOT IN (SELECT (package, opt_level) FROM levels) AND (package, opt_level) NOT IN (SELECT (package, opt_level) FROM gaps) GROUP BY package", ["expected", "levels", "gaps"]),
    "stale_gaps": ("SELECT package AS subject, opt_level AS detail FROM gaps WHERE (package, opt_level) IN (SELECT (package, opt_level) FROM levels)", ["gaps", "levels"]),
}


def _register(name: str) -> None:
    text, needs = CHECK_SQL[name]

    def run(spark, d):
        return checks.CHECKS[name][1](tables(spark, d))

    query(f"check_{name}", text, *needs)(run)


for _name in checks.CHECKS:
    _register(_name)


@query(
    "check_summary",
    " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{checks.CHECKS[n][0]}' AS severity, (SELECT count(*) FROM ({text})) AS n" for n, (text, _) in CHECK_SQL.items()),
    *dict.fromkeys(x for _, needs in CHECK_SQL.values() for x in needs),
)
def check_summary(spark, d):
    return checks.summary(tables(spark, d))


@query(
    "event_seq_assign",
    "SELECT b.event_id, b.binary_id, (coalesce(m, 0) + row_number() OVER (PARTITION BY b.binary_id ORDER BY ts, event_id))::BIGINT AS seq FROM numbered b LEFT JOIN (SELECT binary_id, max(seq) AS m FROM numbered WHERE event_id % 2 = 0 GROUP BY 1) USING (binary_id) WHERE event_id % 2 = 1",
    "numbered",
)
def event_seq_assign(spark, d):
    e = event_log(spark, d)
    numbered = e.withColumn("seq", F.row_number().over(Window.partitionBy("binary_id").orderBy("ts", "event_id")))
    batch = e.where("event_id % 2 = 1")
    return store.append_events(numbered.where("event_id % 2 = 0"), batch, ["ts", "event_id"]).select("event_id", "binary_id", "seq")


@query("event_links_explode", "SELECT DISTINCT o_orderkey AS event_id, unnest(['order', 'customer']) AS entity_kind, unnest([o_orderkey, o_custkey]) AS entity_id, unnest(['subject', 'target']) AS role FROM orders")
def event_links_explode(spark, d):
    link = lambda kind, key, role: F.struct(F.lit(kind).alias("entity_kind"), F.col(key).alias("entity_id"), F.lit(role).alias("role"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.array(link("order", "o_orderkey", "subject"), link("customer", "o_custkey", "target")).alias("links"))
    return store.explode_links(events)


@query("link_edges", "SELECT o_orderkey AS event_id, o_orderkey AS source, o_custkey AS target FROM orders")
def link_edges(spark, d):
    return store.edges(event_links_explode(spark, d))


@query("run_close_stale", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-08-02' - INTERVAL 600 MINUTE THEN 'failed' ELSE status END AS status FROM runs) GROUP BY status", "runs")
def run_close_stale(spark, d):
    return store.close_stale_runs(runs(spark, d), NOW, 600).groupBy("status").agg(F.count("*").alias("n"))


@query("run_active", "SELECT id, started_at::VARCHAR AS started_at FROM runs WHERE status = 'running' AND kind = 'train' AND started_at > TIMESTAMP '1998-08-02' - INTERVAL 10000000 MINUTE", "runs")
def run_active(spark, d):
    return store.active_runs(runs(spark, d), "train", NOW, 10_000_000).select("id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("upsert_first_seen", "SELECT DISTINCT l_partkey AS id, l_partkey % 97 = 0 AS first_seen FROM lineitem")
def upsert_first_seen(spark, d):
    existing = table(spark, d, "part").where("p_partkey % 97 <> 0").select(F.col("p_partkey").alias("id"))
    return store.upsert(existing, table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), ["id"])


@query("replace_listing", "SELECT p_partkey AS function_id, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS listing FROM part")
def replace_listing(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("function_id"), F.col("p_name").alias("listing"))
    new = old.where("function_id % 5 = 0").withColumn("listing", F.upper("listing"))
    return store.replace_rows(old, new, ["function_id"])


@query("import_negative_address", "SELECT p_size::BIGINT AS binary_id, p_brand AS library, p_type AS name, -row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_type) AS address FROM (SELECT DISTINCT p_size, p_brand, p_type FROM part)")
def import_negative_address(spark, d):
    return store.import_addresses(table(spark, d, "part").select(F.col("p_size").cast("long").alias("binary_id"), F.col("p_brand").alias("library"), F.col("p_type").alias("name")))


@query(
    "import_runs_renumber",
    "SELECT id, (SELECT max(id) FROM runs WHERE id % 3 <> 0) + row_number() OVER (ORDER BY id) AS new_id FROM runs WHERE id % 2 = 0 AND (code_version, started_at, kind) NOT IN (SELECT (code_version, started_at, kind) FROM runs WHERE id % 3 <> 0)",
    "runs",
)
def import_runs_renumber(spark, d):
    r = runs(spark, d)
    return store.fresh_runs(r.where("id % 3 <> 0"), r.where("id % 2 = 0")).select("id", "new_id")


@query("measurement_rename", "SELECT id, CASE WHEN regexp_matches(method, '^encoder-[0-9]+(-start)?$') AND regexp_extract(method, '[0-9]+') = id::VARCHAR THEN 'encoder-' || (id + 100) || regexp_extract(method, '(-start)?$') ELSE method END AS method FROM meas", "meas")
def measurement_rename(spark, d):
    m = tables(spark, d)["measurements"]
    return m.select("id", store.renamed(F.col("method"), F.col("id"), F.col("id") + 100).alias("method"))


@query("export_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("nation", "orders", "lineitem")))
def export_table_counts(spark, d):
    return snapshots.table_counts({t: table(spark, d, t) for t in ("nation", "orders", "lineitem")})


@query("migrate_add_column", "SELECT id, binary_id, NULL::VARCHAR AS library FROM functions", "functions")
def migrate_add_column(spark, d):
    old = tables(spark, d)["functions"].drop("library")
    return migrations.STEPS[2]({"functions": old})["functions"].select("id", "binary_id", "library")


@query("corpus_pairs", "SELECT b.binary_id, t.binary_id AS debug_id, b.package, b.opt_level FROM linked b JOIN linked t ON t.binary_id = b.twin_id WHERE b.stripped AND NOT t.stripped", "linked")
def corpus_pairs(spark, d):
    linked = store.link_twins(corpus(spark, d))
    debug = linked.where(~F.col("stripped")).select(F.col("binary_id").alias("debug_id"))
    return linked.where("stripped").join(debug, F.col("twin_id") == F.col("debug_id")).select("binary_id", "debug_id", "package", "opt_level")


@query("stored_levels", "SELECT * FROM levels", "levels")
def stored_levels(spark, d):
    return store.stored_levels(corpus(spark, d))


@query("complete_groups", "SELECT package FROM levels GROUP BY package HAVING count(DISTINCT opt_level) = 4", "levels")
def complete_groups(spark, d):
    return store.complete_packages(corpus(spark, d))


@query("prune_duplicates", "SELECT binary_id FROM (SELECT binary_id, max(binary_id) OVER (PARTITION BY package, owner, opt_level, stripped) AS newest FROM corpus) WHERE binary_id < newest", "corpus")
def prune_duplicates(spark, d):
    return store.duplicate_registrations(corpus(spark, d), ["package", "owner", "opt_level", "stripped"]).select("binary_id")


@query(
    "unregister",
    "WITH gone AS (SELECT binary_id FROM corpus WHERE binary_id % 10 = 3) SELECT binary_id, CASE WHEN twin_id NOT IN (SELECT binary_id FROM gone) THEN twin_id END AS twin_id FROM linked WHERE binary_id NOT IN (SELECT binary_id FROM gone)",
    "linked",
)
def unregister(spark, d):
    linked = store.link_twins(corpus(spark, d))
    return store.unregister(linked, linked.where("binary_id % 10 = 3")).select("binary_id", "twin_id")


@query("truth_match", "SELECT t.id, f.id AS function_id FROM truth t LEFT JOIN functions f ON f.binary_id = t.binary_id AND f.address = t.address AND NOT f.is_external", "truth", "functions")
def truth_match(spark, d):
    t = tables(spark, d)
    return store.match_truth(t["ground_truth"], t["functions"]).select("id", "function_id")


@query("truth_match_rate", "SELECT count(*) AS truths, count(f.id) AS matched, round(count(f.id) / count(*), 6) AS rate FROM truth t LEFT JOIN functions f ON f.binary_id = t.binary_id AND f.address = t.address AND NOT f.is_external", "truth", "functions")
def truth_match_rate(spark, d):
    return truth_match(spark, d).agg(F.count("*").alias("truths"), F.count("function_id").alias("matched"), F.round(F.count("function_id") / F.count("*"), 6).alias("rate"))


@query("measurement_history", "SELECT id, method FROM meas WHERE starts_with(method, 'bm25') ORDER BY id DESC LIMIT 40", "meas")
def measurement_history(spark, d):
    return store.history(tables(spark, d)["measurements"], method="bm25").select("id", "method")


@query("find_functions", "SELECT function_id, package, opt_level, name FROM eligible WHERE package = 'NATION_3' AND opt_level = 'O0'", "eligible")
def find_functions(spark, d):

    return find(fn(spark, d), package="NATION_3", opt_level="O0", eligible=eligible(spark, d)).select("function_id", "package", "opt_level", "name")


@query("sample_functions", "SELECT function_id FROM fn ORDER BY md5('1:' || function_id), function_id LIMIT 100", "fn")
def sample_functions(spark, d):

    return fn(spark, d).select("function_id").orderBy(seeded_order(1, "function_id"), "function_id").limit(100)
