"""Queries of migrations, gaps, sources, listings and other small operators."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import fill, listing
from quernstone.operators import browse, pairs, store
from quernstone.plans.bindings import SQL, corpus, event_log, fn, table
from quernstone.plans.catalogue import query
from quernstone.plans.dataset_queries import FIXED, eligible, fixed_splits
from quernstone.plans.retrieval_queries import _LINES, _listings
from quernstone.schemas import TABLES
from quernstone.sources import manifest, migrations, snapshots
from quernstone.streaming.ingest import late_counts as windowed


def _old_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A store of the first version: events know no run, functions no library."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    binaries = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("path"), F.md5("n_name").alias("sha256"), F.lit("x86").alias("arch"), at.alias("imported_at"))
    functions = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("id"), (F.col("s_nationkey") + 1).alias("binary_id"), (F.col("s_suppkey") * 16).alias("address"), F.lit(64).cast("long").alias("size"), F.col("s_name").alias("raw_name"), F.lit(False).alias("is_external"), F.lit(False).alias("is_thunk"))
    e = event_log(spark, d)
    events = e.select(F.col("event_id").alias("id"), (F.col("binary_id") % 25 + 1).alias("binary_id"), F.lit(1).cast("long").alias("seq"), F.col("ts").alias("created_at"), "type", "payload")
    return {"binaries": binaries, "functions": functions, "events": events}


_COUNTS = {"binaries": "SELECT count(*) FROM nation", "functions": "SELECT count(*) FROM supplier", "events": "SELECT count(*) FROM events", "runs": "SELECT 1"}
_MIGRATED = ["basic_blocks", "binaries", "corpus_binaries", "corpus_gaps", "dataset_split", "events", "function_code", "functions", "ground_truth", "measurements", "runs"]


@query("migrate_steps", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{' '.join(sorted(TABLES[t].names))}' AS columns, ({_COUNTS.get(t, 'SELECT 0')})::BIGINT AS n" for t in _MIGRATED))
def migrate_steps(spark, d):
    """All ten steps over the old tables: what each table is then."""
    out = None
    for name, df in sorted(migrations.migrate(_old_tables(spark, d), 0).items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(" ".join(sorted(df.columns))).alias("columns"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("legacy_run", "SELECT 1::BIGINT AS id, 'legacy' AS kind, 'ok' AS status, count(*) AS events, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM events")
def legacy_run(spark, d):
    moved = migrations.migrate(_old_tables(spark, d), 0, to=1)
    per = moved["events"].groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("events"))
    return moved["runs"].join(per, "id").select("id", "kind", "status", "events", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended"))


@query("split_lock", "SELECT s_suppkey < 50 AS before, true AS after FROM supplier WHERE s_suppkey = 99")
def split_lock(spark, d):
    """Without a training run the splits are open, with one they are locked."""
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") == 99, "train").otherwise("import").alias("kind"))
    states = [(store.splits_locked(runs.where("id < 99")), store.splits_locked(runs))]
    return spark.createDataFrame(states, "before boolean, after boolean")


@query("binary_paths", "SELECT n_name AS name, 'O' || l AS opt_level, 'debug/' || n_name || '-O' || l || '.dll' AS debug_path, 'stripped/' || n_name || '-O' || l || '.dll' AS stripped_path FROM nation CROSS JOIN range(4) AS r(l)")
def binary_paths(spark, d):
    return manifest.binary_paths(table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("chosen_sources", "SELECT DISTINCT decl_file AS path FROM fn WHERE (decl_file LIKE '/work/%' OR decl_file LIKE '/shared/%') AND decl_file NOT LIKE '%inflate.c'", "fn")
def chosen_sources(spark, d):
    files = fn(spark, d).where("decl_file IS NOT NULL").select(F.translate("decl_file", "\\", "/").alias("slashed"), F.col("decl_file").alias("path")).distinct()
    return snapshots.chosen_sources(files.select("path"), ["/work/**/*", "/shared/?ommon.c"], ["**/*inflate.c"])


@query("summary_line", "SELECT function_id, printf('%8d  %-20s %s %6d  %s', function_id, package, opt_level, n_instructions, CASE WHEN function_id % 3 = 0 THEN '-' ELSE name END) AS line FROM fn", "fn")
def summary_line(spark, d):
    name = F.when(F.col("function_id") % 3 != 0, F.col("name"))
    return fn(spark, d).select("function_id", browse.summary_line(F.col("function_id"), F.col("package"), F.col("opt_level"), F.col("n_instructions"), name).alias("line"))


@query("header", "SELECT function_id, package || '  ' || opt_level || '  0x' || lower(to_hex(function_id * 16)) || '  ' || substr(md5(name), 1, 12) AS header FROM fn", "fn")
def header(spark, d):
    return fn(spark, d).select("function_id", browse.header(F.col("package"), F.col("opt_level"), F.col("function_id") * 16, F.md5("name")).alias("header"))


@query("shown_listing", f"{_LINES} SELECT function_id, array_to_string(CASE WHEN len(m) > 3 THEN m[1:3] || ['... ' || (len(m) - 3) || ' more'] ELSE m END, ' ') AS shown FROM (SELECT function_id, string_split(mnemonics, ' ') AS m FROM tok)")
def shown_listing(spark, d):
    lines = F.array_join(F.transform(browse.shown_listing(F.col("listing"), 3), lambda x: F.when(x.startswith("..."), x).otherwise(F.split(x, "\t")[1])), " ")
    return _listings(spark, d).select("function_id", lines.alias("shown"))


@query("mnemonics_plain", f"{_LINES} SELECT function_id, len(string_split(mnemonics, ' '))::INT AS n, mnemonics FROM tok")
def mnemonics_plain(spark, d):
    """Any line with two fields counts, unlike for the rankers."""
    rows = _listings(spark, d).withColumn("m", listing.mnemonics(F.regexp_replace("listing", "\t[^\t]*\t[^\t\n]*(?=\n|$)", "")))
    return rows.select("function_id", F.size("m").alias("n"), F.array_join("m", " ").alias("mnemonics"))


@query("listing_lookup", f"{_LINES} SELECT o_orderkey AS function_id, coalesce(tok.mnemonics, '') AS mnemonics FROM orders LEFT JOIN tok ON tok.function_id = o_orderkey AND o_orderkey % 7 <> 0")
def listing_lookup(spark, d):
    """The listing of a function, or the empty text."""
    code = _listings(spark, d).where("function_id % 7 <> 0")
    rows = browse.with_listing(table(spark, d, "orders").select(F.col("o_orderkey").alias("function_id")), code)
    return rows.select("function_id", F.array_join(listing.mnemonics(F.col("listing")), " ").alias("mnemonics"))


@query("resumable", "SELECT o_orderkey AS binary_id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0")
def resumable(spark, d):
    c = corpus(spark, d).select("binary_id", "package")
    binaries = c.select(F.col("binary_id").alias("id"), F.concat(F.lit("bin/"), F.col("binary_id").cast("string")).alias("path"), F.md5(F.col("binary_id").cast("string")).alias("sha256"))
    files = binaries.where("id % 4 = 0").select("path", F.when(F.col("id") % 3 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return pairs.resumable(c, binaries, files).select("binary_id")


@query("gaps", "SELECT 'ALGERIA' AS package, 'O1' AS opt_level, 'no compiler' AS reason WHERE false UNION ALL SELECT n_name, 'O2', 'not built' FROM nation WHERE n_nationkey = 1")
def gaps(spark, d):
    """Two gaps recorded, one of them removed again."""
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("binary_id"), F.col("n_name").alias("package"), F.lit("O0").alias("opt_level"), F.lit(True).alias("stripped"))
    names = [r["package"] for r in c.where("binary_id < 2").orderBy("binary_id").collect()]
    rows = spark.createDataFrame([], TABLES["corpus_gaps"])
    at = datetime.datetime(2024, 1, 1)
    rows = store.record_gap(rows, c, names[0], "O1", " no compiler ", at)
    rows = store.record_gap(rows, c, names[1], "O2", "not built", at)
    return store.remove_gap(rows, names[0], "O1").select("package", "opt_level", "reason")


@query("replace_truth", "SELECT o_orderkey AS id, o_custkey AS binary_id, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 3) THEN 'new' ELSE 'old' END AS name FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 3) OR o_orderkey % 10 = 3")
def replace_truth(spark, d):
    """Truths read anew take the place of all those of their binaries."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("binary_id"))
    return store.replace_partition(rows.withColumn("name", F.lit("old")), rows.where("id % 10 = 3").withColumn("name", F.lit("new")), "binary_id")


@query("split_rows", f"WITH s AS ({FIXED}) SELECT split, count(*) AS n FROM eligible JOIN s USING (package) GROUP BY split", "eligible")
def split_rows(spark, d):
    """Splits as they are stored, joined back to the rows that they divide."""
    rows = eligible(spark, d)
    return rows.join(F.broadcast(fixed_splits(rows)), "package").groupBy("split").agg(F.count("*").alias("n"))


@query("block_counts", "SELECT o_orderkey AS function_id, coalesce(n, 0)::INT AS n_blocks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) ON l_orderkey = o_orderkey")
def block_counts(spark, d):
    blocks = table(spark, d, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("function_id"))
    return store.block_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("function_id")), blocks)


def _functions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("long").alias("binary_id"), (F.col("p_partkey") * 16).alias("address"), F.col("p_brand").alias("library"), F.col("p_name").alias("raw_name"), (F.col("p_partkey") % 4 == 0).alias("is_external"))


@query("function_index", "SELECT (p_size % 10)::BIGINT AS binary_id, p_partkey * 16 AS address, p_partkey AS function_id FROM part WHERE p_partkey % 4 <> 0")
def function_index(spark, d):
    return store.function_index(_functions(spark, d))


@query("import_index", "SELECT (p_size % 10)::BIGINT AS binary_id, p_brand AS library, p_name AS name, p_partkey AS function_id FROM part WHERE p_partkey % 4 = 0")
def import_index(spark, d):
    return store.import_index(_functions(spark, d))


@query("kept_strings", "SELECT p_partkey AS id, length(p_name)::BIGINT AS length FROM part WHERE length(p_name) >= 6 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 3 = 0)")
def kept_strings(spark, d):
    strings = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").cast("long").alias("length"))
    return store.kept_strings(strings, table(spark, d, "lineitem").where("l_suppkey % 3 = 0").select(F.col("l_partkey").alias("string_id")), 6)


@query("late_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS starts, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def late_counts(spark, d):
    """The counts of a stream by the hour, over a table: nothing comes late there."""
    counts = windowed(event_log(spark, d))
    return counts.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("starts"), "type", "n")


_G, _I, _M = fill.GOLDEN, fill.GOLDEN_INVERSE, 1 << 64


@query(
    "fill_words",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN u >= {1 << 63} THEN (u::HUGEINT - {_M}) ELSE u::HUGEINT END::BIGINT AS word FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_partkey * 8)::UHUGEINT * {_G}::UHUGEINT + l_suppkey::UHUGEINT) % {_M}::UHUGEINT AS u FROM lineitem)",
)
def fill_words(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", fill.fill_value(F.col("l_partkey") * 8, F.col("l_suppkey")).alias("word"))


SQL["moved_words"] = f"""SELECT l_orderkey, l_linenumber, seed, CASE WHEN abs(word::HUGEINT) < 9000000000000000000 THEN word + moved WHEN word > 0 THEN word - 2000 ELSE word + 2000 END AS address
FROM (SELECT *, CASE WHEN u >= {1 << 63} THEN (u::HUGEINT - {_M}) ELSE u::HUGEINT END::BIGINT AS word FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS seed, l_orderkey % 2049 - 1024 AS moved, ((l_partkey * 8 % {fill.GAMMA})::UHUGEINT * {_G}::UHUGEINT + (l_suppkey % 3)::UHUGEINT) % {_M}::UHUGEINT AS u FROM lineitem))"""
#: Every displacement within reach, nearer ones first and of equal ones that above 0.
FILL_ORIGIN = f"""WITH one AS (SELECT address, seed, ((((address::HUGEINT - seed) % {_M} + {_M}) % {_M})::UHUGEINT * {_I}::UHUGEINT % {_M}::UHUGEINT)::HUGEINT AS b FROM (SELECT DISTINCT address, seed FROM moved_words)),
step AS (SELECT d, ((((-d::HUGEINT) % {_M} + {_M}) % {_M})::UHUGEINT * {_I}::UHUGEINT % {_M}::UHUGEINT)::HUGEINT AS s FROM (SELECT unnest(range(-{fill.REACH}, {fill.REACH + 1})) AS d)),
tried AS (SELECT address, seed, d, CASE WHEN b + s >= {_M} THEN b + s - {_M} ELSE b + s END AS o FROM one CROSS JOIN step),
found AS (SELECT address, seed, arg_min(o, 2 * abs(d) + (d < 0)::INT)::BIGINT AS o, arg_min(d, 2 * abs(d) + (d < 0)::INT) AS d FROM tried WHERE o < {fill.GAMMA} AND o % 8 = 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, seed, address, coalesce(o, -1) AS "offset", coalesce(d, 0) AS displacement FROM moved_words LEFT JOIN found USING (address, seed)"""


@query("fill_origin", FILL_ORIGIN, "moved_words")
def fill_origin(spark, d):
    """Addresses made of words of the fill and a displacement, traced back."""
    seed = (F.col("l_suppkey") % 3).cast("long")
    offset = (F.col("l_partkey") * 8) % fill.GAMMA
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", seed.alias("seed"), offset.alias("made_of"), fill.fill_value(offset, seed).alias("word"), (F.col("l_orderkey") % 2049 - 1024).alias("moved"))
    signed = F.when(F.col("word") > 0, F.col("word") - 2000).otherwise(F.col("word") + 2000)  # away from the ends of bigint
    near = F.when(F.abs("word") < 9_000_000_000_000_000_000, F.col("word") + F.col("moved")).otherwise(signed)
    found = rows.withColumn("address", near).withColumn("o", fill.fill_origin("address", "seed"))
    return found.select("l_orderkey", "l_linenumber", "seed", "address", F.col("o.offset").alias("offset"), F.col("o.displacement").alias("displacement"))
