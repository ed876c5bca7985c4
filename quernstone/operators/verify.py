"""The verifier's flow over tables of what runs did.

Producers hand over outcomes, stores, recorded pages and calls; here they become
effects that differ, buffers that changed, values that settled, layers of a true
pair with their fallback, and false pairs that were and were not judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import fill
from quernstone.operators.verdict import BUFFER_STRIDE, CASE, COMPLETED, INPUT_BASE, INPUT_END, PAGE, REFUTED, RUNS, SURVIVED, touched_bytes

#: Fixed: what runs may differ in beyond memory, in the order in which it is asked.
CALLS, NULLNESS, BUFFERS = "calls a compiler cannot add or remove differ", "a returned pointer is null in one version only", "a different set of argument buffers changed"
LAYERS = ("bare", "stubbed", "chained")
CHAIN_FAILED, LOAD_FAILED = "chain_failed", "load_failed"


def cells(column: str, runs: Sequence[tuple[str, str]] = RUNS) -> list[Column]:
    """A column for each of a case's four runs."""
    return [F.max(F.when((F.col("side") == s) & (F.col("seed") == e), F.col(column))).alias(f"{column}_{s}{e}") for s, e in runs]


def settled_pair(column: str) -> Column:
    """Whether both seeds of each side agree on a column of `cells`, none of them null."""
    c = lambda run: F.col(f"{column}_{run}")
    return F.coalesce((c("QA") == c("QB")) & (c("KA") == c("KB")), F.lit(False))


def effect_difference(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(case, effect, q, k): the first thing beyond memory in which the sides differ.

    runs: case, side, seed, effects (text, null if the list overflowed), ret_int,
    changed (text of the buffers that changed, null if it was not asked). kinds:
    pair_id, kind of the return. What moves with a seed is not compared. Cases
    without a difference are absent.
    """
    null = F.when(F.col("kind") == "pointer", (F.col("ret_int") == 0).cast("string"))
    rows = runs.join(kinds, "pair_id").withColumn("is_null", null)
    wide = rows.groupBy(*CASE).agg(*cells("effects"), *cells("is_null"), *cells("changed"))
    found = F.lit(None).cast("struct<effect:string,q:string,k:string>")
    for column, reason in (("changed", BUFFERS), ("is_null", NULLNESS), ("effects", CALLS)):
        apart = settled_pair(column) & (F.col(f"{column}_QA") != F.col(f"{column}_KA"))
        found = F.when(apart, F.struct(F.lit(reason).alias("effect"), F.col(f"{column}_QA").alias("q"), F.col(f"{column}_KA").alias("k"))).otherwise(found)
    return wide.select(*CASE, found.alias("f")).where("f IS NOT NULL").select(*CASE, "f.*")


def changed_buffers(stores: DataFrame, pages: DataFrame, initial: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(run, changed): the input buffers that hold a byte that was not put there, as
    sorted indexes; a run without one has an empty array.

    stores: run, address, size. pages: run, page, content, the bytes that each
    recorded page ended with. initial: variant, page, content, what an input page
    began with. copies: pair_id, side, buffer, by-value aggregates, left out.
    """
    run = [*CASE, "side", "seed"]
    inside = stores.where(F.col("address").between(INPUT_BASE, INPUT_END - 1))
    touched = touched_bytes(inside, pages.select(*run, "page"))
    byte = lambda content: F.substring(content, F.col("offset") + 1, F.lit(1))
    ended = touched.join(pages.select(*run, "page", F.col("content").alias("after")), [*run, "page"])
    began = ended.join(initial.select("variant", "page", F.col("content").alias("before")), ["variant", "page"])
    apart = began.where(byte(F.col("after")) != byte(F.col("before")))
    found = apart.select(*run, F.floor((F.col("page") - INPUT_BASE) / BUFFER_STRIDE).cast("int").alias("buffer")).distinct()
    if copies is not None:
        found = found.join(copies.select("pair_id", "side", "buffer"), ["pair_id", "side", "buffer"], "left_anti")
    sets = found.groupBy(*run).agg(F.array_sort(F.collect_set("buffer")).alias("changed"))
    every = pages.select(*run).unionByName(stores.select(*run)).distinct()
    return every.join(sets, run, "left").withColumn("changed", F.coalesce("changed", F.array().cast("array<int>")))


def changed_of_runs(runs: DataFrame, initial: DataFrame) -> DataFrame:
    """(run, changed), as `changed_buffers` has them, of rows that hold one run of a
    case or several that stored the same and left the same pages: stores, an array of
    (address, size); pages, an array of (page, content); runs, an array of (side, seed,
    copies), the last an array of buffers, or null. Only the few rows of initial are
    brought to them."""
    began = initial.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("page", "content"))).alias("began"))
    rows = runs.join(F.broadcast(began), "variant", "left")  # a row for each fill

    def apart(p: Column, s: Column) -> Column:
        low, high = F.greatest(s["address"] - p["page"], F.lit(0)), F.least(s["address"] + s["size"] - p["page"], F.lit(PAGE))
        part = lambda content: F.substring(content, (low + 1).cast("int"), (high - low).cast("int"))
        inside = s["address"].between(INPUT_BASE, INPUT_END - 1) & (s["size"] > 0) & (low < high)
        return inside & (part(p["content"]) != part(F.try_element_at("began", p["page"])))

    moved = F.filter("pages", lambda p: F.exists("stores", lambda s: apart(p, s)))
    found = F.array_sort(F.array_distinct(F.transform(moved, lambda p: F.floor((p["page"] - INPUT_BASE) / BUFFER_STRIDE).cast("int"))))
    each = rows.select(*CASE, F.coalesce(found, F.array().cast("array<int>")).alias("found"), F.explode("runs").alias("r"))
    left = F.when(F.col("r.copies").isNull() | (F.size("found") == 0), F.col("found")).otherwise(F.array_except("found", "r.copies"))
    return each.select(*CASE, "r.side", "r.seed", left.alias("changed"))


def copy_buffers(params: DataFrame, stride: int = BUFFER_STRIDE) -> DataFrame:
    """(pair_id, side, buffer): buffers that hold the callee's own copy of an
    aggregate. params: pair_id, side, by_reference, value (the argument's address)."""
    buffer = F.floor((F.col("value") - INPUT_BASE) / stride).cast("int")
    return params.where(F.col("by_reference") & F.col("value").between(INPUT_BASE, INPUT_END - 1)).select("pair_id", "side", buffer.alias("buffer")).distinct()


def settled_values(outcomes: DataFrame, observations: DataFrame, garbage_returns: DataFrame | None = None) -> DataFrame:
    """(case, observation, q, k): what each side settled on under one fill.

    outcomes: case, side, seed, status, invented. observations: case, side, seed,
    observation, value. garbage_returns: case, of inputs whose return moved with the
    seed. All four runs completed, read no invented memory, and each side's two
    seeds agree; otherwise a row is absent.
    """
    clean = outcomes.groupBy(*CASE).agg(F.bool_and((F.col("status") == COMPLETED) & ~F.col("invented")).alias("ok"), F.count("*").alias("n"))
    clean = clean.where(F.col("ok") & (F.col("n") == len(RUNS))).select(*CASE)
    if garbage_returns is not None:
        clean = clean.join(garbage_returns.select(*CASE).distinct(), CASE, "left_anti")
    wide = observations.groupBy(*CASE, "observation").agg(*cells("value")).join(clean, CASE, "left_semi")
    return wide.where(settled_pair("value")).select(*CASE, "observation", F.col("value_QA").alias("q"), F.col("value_KA").alias("k"))


def three_layers(attempts: DataFrame, chains: DataFrame) -> DataFrame:
    """(pair_id, layer, bucket, agreement, chain_found, abandoned).

    attempts: pair_id, layer, bucket, agreement, what each layer's own run gave;
    a pair that failed to load has the bucket load_failed in any of them. chains:
    pair_id, side with an initialiser. The third layer stands only for pairs with a
    chain on both sides; one that ends in chain_failed is abandoned for the second.
    """
    both = chains.groupBy("pair_id").agg((F.count_distinct("side") == 2).alias("chain_found"))
    cell = lambda layer, c: F.max(F.when(F.col("layer") == layer, F.col(c)))
    wide = attempts.groupBy("pair_id").agg(F.bool_or(F.col("bucket") == LOAD_FAILED).alias("unloaded"), *[F.struct(cell(x, "bucket").alias("bucket"), cell(x, "agreement").alias("agreement")).alias(x) for x in LAYERS])
    wide = wide.join(both, "pair_id", "left").withColumn("chain_found", F.coalesce("chain_found", F.lit(False)) & ~F.col("unloaded"))
    failed = F.col("chain_found") & (F.col("chained.bucket") == CHAIN_FAILED)
    none = F.struct(F.lit(LOAD_FAILED).alias("bucket"), F.lit(None).cast("string").alias("agreement"))
    third = F.when(F.col("chain_found") & ~failed, F.col("chained")).otherwise(F.col("stubbed"))
    layers = F.array(*[F.struct(F.lit(x).alias("layer"), F.when(F.col("unloaded"), none).otherwise(c).alias("r")) for x, c in zip(LAYERS, (F.col("bare"), F.col("stubbed"), third))])
    out = wide.withColumn("abandoned", failed).withColumn("l", F.explode(layers))
    return out.select("pair_id", "l.layer", F.col("l.r.bucket").alias("bucket"), F.col("l.r.agreement").alias("agreement"), "chain_found", (F.col("abandoned") & (F.col("l.layer") == "chained")).alias("abandoned"))


def layer_report(layers: DataFrame) -> DataFrame:
    """(layer, bucket, agreement, pairs, abandoned): what a verify run counts."""
    return layers.groupBy("layer", "bucket", "agreement").agg(F.count("*").alias("pairs"), F.count_if("abandoned").alias("abandoned"))


def stopped_details(inputs: DataFrame, status: str, name: Column, top: int | None = None) -> DataFrame:
    """(name, pairs): for the pairs that most inputs stopped with a status, the
    commonest name of each, and how many pairs have it, the largest first.

    inputs: pair_id, status, detail. Of equally common statuses the larger counts,
    of equally common names the first one.
    """
    stops = inputs.where("status IS NOT NULL")
    mode = stops.groupBy("pair_id", "status").agg(F.count("*").alias("n")).groupBy("pair_id").agg(F.max_by("status", F.struct("n", "status")).alias("status"))
    pairs = mode.where(F.col("status") == status).select("pair_id")
    names = stops.where(F.col("status") == status).join(pairs, "pair_id", "left_semi").withColumn("name", name)
    first = names.groupBy("pair_id", "name").agg(F.count("*").alias("n"), F.min("input_idx").alias("at")).groupBy("pair_id").agg(F.max_by("name", F.struct("n", -F.col("at"))).alias("name"))
    counts = first.where("name <> ''").groupBy("name").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "name")
    return counts.limit(top) if top is not None else counts


def missing_imports(inputs: DataFrame, top: int | None = None) -> DataFrame:
    """The functions that most pairs lack a stub for, by the name before the colon."""
    return stopped_details(inputs, "import_without_stub", F.trim(F.substring_index(F.coalesce("detail", F.lit("")), ":", 1)), top)


def declined_stubs(inputs: DataFrame, top: int | None = None) -> DataFrame:
    """The stubs that refused, with the reason that they gave."""
    return stopped_details(inputs, "stub_declined", F.coalesce("detail", F.lit("")), top)


def false_pair_verdicts(tasks: DataFrame, loads: DataFrame, compared: DataFrame) -> DataFrame:
    """(pair_id, verdict, forced_only, unjudged): one row for every pair asked for.

    tasks: pair_id. loads: pair_id, error, of pairs whose binaries could not be
    opened. A pair that is neither judged nor failed to load stops the run: nothing
    is dropped in silence.
    """
    rows = tasks.select("pair_id").join(loads.groupBy("pair_id").agg(F.min("error").alias("error")), "pair_id", "left")
    rows = rows.join(compared.select("pair_id", "verdict", "forced_only"), "pair_id", "left")
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("load failed: "), "error"))
    lost = F.raise_error(F.concat(F.lit("pair was not judged: "), F.col("pair_id").cast("string")))
    judged = lambda c: F.when(reason.isNull(), F.col(c))
    verdict = F.when(reason.isNull(), F.coalesce("verdict", lost.cast("string")))
    return rows.select("pair_id", verdict.alias("verdict"), judged("forced_only").alias("forced_only"), reason.alias("unjudged"))


def r0_report(verdicts: DataFrame) -> DataFrame:
    """(verdict, unjudged, pairs, forced): verdicts and, apart from them, reasons."""
    return verdicts.groupBy("verdict", "unjudged").agg(F.count("*").alias("pairs"), F.count_if(F.coalesce("forced_only", F.lit(False))).alias("forced"))


def foreign_regions(images: DataFrame, stack_top: int, stack_size: int) -> DataFrame:
    """(pair_id, low, high) of what the two builds lay out apart: both images, and
    the stack. images: pair_id, side, base, size."""
    own = images.select("pair_id", F.col("base").alias("low"), (F.col("base") + F.col("size")).alias("high"))
    stack = images.select("pair_id", F.lit(stack_top - stack_size).cast("long").alias("low"), F.lit(stack_top).cast("long").alias("high"))
    return own.unionByName(stack).distinct()


def foreign_pointer_windows(stable: DataFrame, regions: DataFrame) -> DataFrame:
    """(case, page, offset): bytes of eight in a row that both sides have and that
    are an address into a foreign region on either of them.

    stable: case, side, page, offset, byte. regions: pair_id, low, high, a few each.
    """
    place = [*CASE, "page"]
    row = Window.partitionBy(*place, "side").orderBy("offset")
    ahead = [F.lead("byte", i).over(row) for i in range(8)]
    value = sum((F.call_function("shiftleft", x.cast("long"), F.lit(8 * i)) for i, x in enumerate(ahead)), F.lit(0).cast("long"))
    windows = stable.select(*place, "side", "offset", F.lead("offset", 7).over(row).alias("last"), *[x.isNull().alias(f"gone_{i}") for i, x in enumerate(ahead)], F.when(ahead[7] < 128, value).alias("value"))
    windows = windows.where("last = offset + 7")
    side = lambda s: windows.where(F.col("side") == s).select(*place, "offset", F.col("value").alias(s.lower()))
    both = side("Q").join(side("K"), [*place, "offset"]).join(regions, "pair_id")
    inside = lambda c: F.coalesce((F.col(c) >= F.col("low")) & (F.col(c) < F.col("high")), F.lit(False))
    hit = both.where(inside("q") | inside("k"))
    return hit.select(*place, F.explode(F.sequence(F.col("offset"), F.col("offset") + 7)).alias("offset")).distinct()


def stack_origin(addresses: DataFrame, words: DataFrame, reach: int = fill.REACH) -> DataFrame:
    """addresses (id, seed, address) with from_stack: whether a word of that seed's
    stack garbage is within reach. words: seed, word.

    Both are cut into strips as wide as the reach; a word is dealt to its own strip
    and the two beside it, so the join has only equalities before the distance.
    """
    strip = lambda c: F.floor(c / reach)
    near = words.distinct().withColumn("strip", F.explode(F.array(*[strip(F.col("word")) + i for i in (-1, 0, 1)])))
    hit = addresses.withColumn("strip", strip(F.col("address"))).join(near, ["seed", "strip"]).where(F.abs(F.col("address") - F.col("word")) <= reach).select("id").distinct()
    return addresses.join(hit.withColumn("from_stack", F.lit(True)), "id", "left").withColumn("from_stack", F.coalesce("from_stack", F.lit(False)))


def flip_directive(branches: DataFrame) -> DataFrame:
    """branches (…, count, taken, fall_through, target) with the other destination."""
    return branches.withColumn("destination", F.when(F.col("taken"), F.col("fall_through")).otherwise(F.col("target")))


#: Fixed: the shape of the draws of positions, which lie near the ends of a ranking.
FLIP_SHAPE = 0.03


def flip_positions(count: int, seed: int) -> list[float]:
    """Positions in a ranking, U-shaped and reproducible: the same seed gives both
    sides the same ones."""
    import numpy as np

    return np.random.default_rng([0xF11B, seed]).beta(FLIP_SHAPE, FLIP_SHAPE, count).tolist()


def chain_for(functions: DataFrame, matches: DataFrame, initialisers: DataFrame, context: int = INPUT_BASE) -> DataFrame:
    """(function_id, initialiser_id, address, arguments, returns_context): what runs
    before a function: the one initialiser that matched it, if it can be placed.

    It gets the context pointer that the function will get, and a zero for each
    integer after it; one that returns the context gets zeros only. matches:
    function_id, initialiser_id. initialisers: initialiser_id, address, placeable,
    n_params, returns_context.
    """
    rows = functions.select("function_id").join(matches, "function_id").join(initialisers, "initialiser_id").where("placeable")
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    inside = F.concat(F.array(F.lit(context).cast("long")), zeros(F.greatest(F.col("n_params") - 1, F.lit(0))))
    arguments = F.when(F.col("returns_context"), zeros(F.col("n_params"))).otherwise(inside)
    return rows.select("function_id", "initialiser_id", "address", arguments.alias("arguments"), "returns_context")


def pair_summary(compared: DataFrame, inputs: DataFrame, calls: DataFrame, wild: DataFrame) -> DataFrame:
    """(pair_id, verdict, forced_only, survived, decided, differing, wild): per pair,
    the inputs that survived and those that were decided, the names called a
    different number of times, and where its telling wild access came from.

    inputs: pair_id, verdict. calls: pair_id, name of such names. wild: pair_id, origin.
    """
    mass = inputs.groupBy("pair_id").agg(F.count_if(F.col("verdict") == SURVIVED).alias("survived"), F.count_if(F.col("verdict").isin(SURVIVED, REFUTED)).alias("decided"))
    names = calls.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("differing"))
    out = compared.select("pair_id", "verdict", "forced_only").join(mass, "pair_id", "left").join(names, "pair_id", "left").join(wild.select("pair_id", F.col("origin").alias("wild")), "pair_id", "left")
    return out.na.fill(0, ["survived", "decided"]).na.fill("", ["differing"])


def page_of(address: Column) -> Column:
    return address - address % PAGE
