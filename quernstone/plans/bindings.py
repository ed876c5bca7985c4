"""The driver's tables as the engine's contracts, in Spark and in SQL.

An order with lines stands for a function, its lines for instructions, its
customer's nation for the package and its region for the domain. SQL has the same
rows by name, for queries to build on: ``sql("...", "fn", ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_INSTRUCTIONS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package and domain of each nation; a fixed 25 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("package"), F.col("r_name").alias("domain"))


def decl_file(package: Column, segment: Column, customer: Column) -> Column:
    """Source paths of every kind: toolchain, dependency, shared, none, own."""
    return (
        F.when(customer % 40 == 0, F.format_string("/opt/mingw-w64-crt/stdio_%s.c", (customer % 3).cast("string")))
        .when(customer % 41 == 0, F.concat(F.lit("/work/"), package, F.lit("\\_deps\\zlib\\inflate.c")))
        .when(customer % 43 == 0, F.lit("/shared/common.c"))
        .when(customer % 47 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/work/"), package, F.lit("/"), segment, F.lit(".c")))
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function rows: ids, names, provenance, tokens and counts."""
    # dealt once, a row for each line; what follows from the lines of an order is made
    # of them after that. A token is made of columns before the date, so that only
    # orders equal lines.
    columns = LINE_ORDER[: LINE_ORDER.index("l_shipdate")]
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *columns).repartition("l_orderkey")
    per = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines"))
    token = lambda x: F.concat(x["l_returnflag"], x["l_linestatus"], F.lit("_"), F.floor(x["l_quantity"] / 10).cast("string"))
    known = lambda c: F.filter(F.array_distinct(c), lambda x: x.isNotNull())
    per = per.select(
        "l_orderkey",
        F.transform("lines", token).alias("tokens"),
        F.size("lines").alias("n_instructions"),
        F.size(F.filter("lines", lambda x: x["l_discount"] >= 0.05)).alias("n_calls"),
        F.size(known(F.col("lines.l_suppkey"))).alias("n_blocks"),
        F.array_sort(known(F.transform("lines", lambda x: F.concat(F.lit("P"), (x["l_partkey"] % 50).cast("string"))))).alias("imports"),
    )
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owner = customer.join(F.broadcast(places(spark, sf_dir)), customer.c_nationkey == F.col("n_nationkey"))
    owned = order.join(owner, F.col("o_custkey") == F.col("c_custkey"))  # narrow rows, dealt by customer before they meet the lines
    rows = per.join(owned, per.l_orderkey == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("function_id"),
        "package",
        "domain",
        decl_file(F.col("package"), F.col("c_mktsegment"), F.col("c_custkey")).alias("decl_file"),
        F.concat(F.lit("fn_"), F.col("c_custkey").cast("string")).alias("name"),
        F.concat(F.lit("O"), (F.col("o_orderkey") % 4).cast("string")).alias("opt_level"),
        "tokens",
        "n_instructions",
        "n_calls",
        "n_blocks",
        "imports",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as what producers hand over: no sequence yet."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("binary_id"), "event_id", "ts", F.col("event_type").alias("type"), F.col("props").alias("payload"), "value")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered binaries: package, level and side of each order."""
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owner = customer.join(F.broadcast(places(spark, sf_dir)), customer.c_nationkey == F.col("n_nationkey")).select("c_custkey", "package")
    return order.join(owner, order.o_custkey == owner.c_custkey).select(
        F.col("o_orderkey").alias("binary_id"),
        "package",
        F.col("o_custkey").alias("owner"),
        F.concat(F.lit("O"), (F.col("o_orderkey") % 4).cast("string")).alias("opt_level"),
        (F.floor(F.col("o_orderkey") / 4) % 2 == 1).alias("stripped"),
        F.col("o_orderdate").alias("registered_at"),
    )


_LINE_ORDER = ", ".join(LINE_ORDER)
SQL = {
    "places": "SELECT n_nationkey, n_name AS package, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey",
    "fn": f"""
SELECT o_orderkey AS function_id, package, domain,
  CASE WHEN c_custkey % 40 = 0 THEN '/opt/mingw-w64-crt/stdio_' || (c_custkey % 3) || '.c'
    WHEN c_custkey % 41 = 0 THEN '/work/' || package || '\\_deps\\zlib\\inflate.c'
    WHEN c_custkey % 43 = 0 THEN '/shared/common.c'
    WHEN c_custkey % 47 = 0 THEN NULL
    ELSE '/work/' || package || '/' || c_mktsegment || '.c' END AS decl_file,
  'fn_' || c_custkey AS name, 'O' || (o_orderkey % 4) AS opt_level, tokens, n_instructions, n_calls, n_blocks, imports
FROM (SELECT l_orderkey,
    list(l_returnflag || l_linestatus || '_' || floor(l_quantity / 10)::BIGINT ORDER BY {_LINE_ORDER}) AS tokens,
    count(*)::INT AS n_instructions, count(*) FILTER (l_discount >= 0.05)::INT AS n_calls, count(DISTINCT l_suppkey)::INT AS n_blocks,
    list_sort(list(DISTINCT 'P' || (l_partkey % 50))) AS imports
  FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "source_files": "SELECT decl_file, count(DISTINCT package) AS packages, count(*) AS n_rows FROM fn WHERE decl_file IS NOT NULL GROUP BY decl_file",
    "excluded_files": """
SELECT decl_file, packages, n_rows, concat_ws('+', CASE WHEN packages > 1 THEN 'shared' END,
  CASE WHEN contains(decl_file, '/mingw-w64-crt/') OR contains(decl_file, '/x86_64-w64-mingw32/') OR contains(decl_file, '/lib/gcc/') OR contains(decl_file, '/gcc-') OR contains(decl_file, '/mingw-w64/include/') THEN 'toolchain' END,
  CASE WHEN contains(replace(decl_file, '\\', '/'), '/_deps/') THEN 'dependency' END) AS reasons
FROM source_files WHERE reasons <> ''""",
    "candidate": f"SELECT fn.*, sha256(list_aggregate(tokens, 'string_agg', ' ')) AS content FROM fn WHERE decl_file IS NOT NULL AND n_instructions >= {MIN_INSTRUCTIONS} AND decl_file NOT IN (SELECT decl_file FROM excluded_files)",
    "duplicate_key": "SELECT content, count(DISTINCT package) AS packages, count(*) AS n_rows FROM candidate GROUP BY content HAVING count(DISTINCT package) > 1",
    "eligible": "SELECT * FROM candidate WHERE content NOT IN (SELECT content FROM duplicate_key)",
    "corpus": """
SELECT o_orderkey AS binary_id, package, o_custkey AS owner, 'O' || (o_orderkey % 4) AS opt_level, (o_orderkey // 4) % 2 = 1 AS stripped, o_orderdate AS registered_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "pool": "SELECT * FROM eligible WHERE opt_level = 'O3'",
    "pool_last": "SELECT package, decl_file, name, arg_max(content, function_id) AS content FROM pool GROUP BY ALL",
    "query": "SELECT e.*, p.content AS gold_content FROM eligible e JOIN pool_last p USING (package, decl_file, name) WHERE opt_level = 'O0'",
    "gold": "SELECT q.function_id AS query_id, p.function_id AS pool_id FROM query q JOIN pool p ON q.gold_content = p.content",
}
#: What each named row set is built on.
NEEDS = {
    "fn": ["places"],
    "source_files": ["fn"],
    "excluded_files": ["source_files"],
    "candidate": ["fn", "excluded_files"],
    "duplicate_key": ["candidate"],
    "eligible": ["candidate", "duplicate_key"],
    "corpus": ["places"],
    "pool": ["eligible"],
    "pool_last": ["pool"],
    "query": ["eligible", "pool_last"],
    "gold": ["query", "pool"],
}


def sql(text: str, *names: str) -> str:
    """text behind the named row sets and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    shared = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    if not shared:
        return text
    head, rest = ("WITH RECURSIVE ", text.lstrip()[len("WITH RECURSIVE ") :]) if text.lstrip().startswith("WITH RECURSIVE ") else ("WITH ", text.lstrip()[5:] if text.lstrip().startswith("WITH ") else "")
    return f"{head}{shared}, {rest}" if rest else f"WITH {shared} {text}"
