"""Calling convention: where arguments go and what values to try, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.picks import uniform

# Fixed values of the convention and of the memory that is handed out.
REGISTER_SLOTS = 4
SLOT_BYTES = 8
SHADOW_BYTES = 32
BUFFER_BASE = 0x2000_0000_0000
BUFFER_STRIDE = 1 << 20
ARENA_BASE = 0x3000_0000_0000
IN_REGISTER = (1, 2, 4, 8)


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def is_aggregate(kind: Column) -> Column:
    return kind.isin("struct", "union")


def by_reference(kind: Column, size: Column) -> Column:
    """Aggregates that travel as the address of a copy."""
    return is_aggregate(kind) & ~F.coalesce(size.isin(*IN_REGISTER), F.lit(False))


def hidden_return(abi: Column) -> Column:
    """Whether the return value is written to memory that leads the arguments."""
    return F.coalesce(by_reference(abi["return"]["kind"], abi["return"]["size"]), F.lit(False))


def declined(kind: Column, size: Column) -> Column:
    """Why a value cannot be placed, or null."""
    return (
        F.when(is_aggregate(kind) & (F.coalesce(size, F.lit(0)) == 0), "aggregate of no size")
        .when((kind == "float") & (size > 8), "float wider than 8 bytes")
        .when(kind.isNull() | kind.isin("complex", "unknown"), "kind not supported")
    )


def decline_reason(abi: Column) -> Column:
    """Why a signature cannot be placed at all, or null."""
    params = F.transform(F.coalesce(abi["params"], F.array().cast("array<struct<kind:string,size:int,signed:boolean>>")), lambda p: declined(p["kind"], p["size"]))
    returned = F.when(abi["return"]["kind"] != "void", declined(abi["return"]["kind"], abi["return"]["size"]))
    return F.when(abi.isNull(), "no signature").when(F.coalesce(abi["variadic"], F.lit(False)), "variadic").otherwise(F.coalesce(returned, F.get(F.array_compact(params), 0)))


def slots(abi: Column) -> Column:
    """The place of each argument: position, register or stack offset, and whether
    it is an address."""
    shift = F.when(hidden_return(abi), 1).otherwise(0)

    def place(p: Column, i: Column) -> Column:
        at = i + shift
        return F.struct(
            at.alias("position"),
            F.when(at < REGISTER_SLOTS, F.concat(F.when(p["kind"] == "float", "xmm").otherwise("int"), at.cast("string"))).alias("register"),
            F.when(at >= REGISTER_SLOTS, SLOT_BYTES * (at - REGISTER_SLOTS)).alias("stack_offset"),
            by_reference(p["kind"], p["size"]).alias("by_reference"),
            F.when(by_reference(p["kind"], p["size"]) | (p["kind"] == "pointer"), SLOT_BYTES).otherwise(F.coalesce(p["size"], F.lit(SLOT_BYTES))).alias("size"),
        )

    return F.transform(abi["params"], place)


def return_mask(kind: Column, size: Column) -> Column:
    """The bits of an integer return that count; 0 for void and pointers."""
    width = F.coalesce(size, F.lit(8))
    return F.when(kind.isin("void", "pointer"), F.lit(0).cast("long")).when(width >= 8, F.lit(-1).cast("long")).otherwise(_power(width * 8) - 1)


def sign_extended(value: Column, size: Column) -> Column:
    """Two's complement of the low bytes of a long."""
    shift = (64 - 8 * size).cast("int")
    return F.when(size >= 8, value).otherwise(F.call_function("shiftright", F.call_function("shiftleft", value, shift), shift))


def selectivity(left: Column, right: Column, size: Column) -> Column:
    """How far a compare is from going the other way, at the operands' width."""
    return F.abs(sign_extended(left, size) - sign_extended(right, size))


def boundary_values(size: Column, signed: Column, seed: int, position: Column) -> Column:
    """Values to try for an integer below 8 bytes: edges and three that a seed draws."""
    mask = _power(size * 8) - 1
    high = _power(size * 8 - 1)
    edges = F.when(signed, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), mask, high, high - 1)).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), mask, F.shiftright(mask, 1)))
    drawn = F.array(*[F.floor(uniform(F.lit(str(seed)), position, F.lit(str(i))) * (mask + 1)).cast("long") for i in range(3)])
    return F.array_distinct(F.concat(edges, drawn))


#: Fixed: floating-point values that every parameter of that kind tries.
FLOATS = (0.0, 1.0, -1.0, 0.5, 2.0, 3.5)


def float_bits(value: Column, size: Column) -> Column:
    """The bits of a number as a float of 4 or 8 bytes: sign, exponent and fraction by
    arithmetic, rounded to the width. Numbers are normal ones or 0."""
    x = F.when(size == 4, value.cast("float").cast("double")).otherwise(value.cast("double"))
    fraction, bias = F.when(size == 4, 23).otherwise(52), F.when(size == 4, 127).otherwise(1023)
    guess = F.floor(F.log2(F.abs(x)))
    scaled = F.abs(x) / F.pow(F.lit(2.0), guess)  # exact; the logarithm may be off by one
    exponent = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    scaled = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    bits = _shifted(exponent + bias, fraction) + ((scaled - 1) * F.pow(F.lit(2.0), fraction)).cast("long")
    sign = F.when(x < 0, _shifted(F.lit(1).cast("long"), F.when(size == 4, 31).otherwise(63))).otherwise(F.lit(0).cast("long"))
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(bits.bitwiseOR(sign))


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value.cast("long"), bits.cast("int"))


def float_values(size: Column, seed: int, position: Column, extra: int = 3) -> Column:
    """Bit patterns to try for a float: ordinary values and some that a seed draws."""
    drawn = [uniform(F.lit(f"float:{seed}"), position, F.lit(str(i))) * 2e6 - 1e6 for i in range(extra)]
    return F.array(*[float_bits(x, size) for x in [*map(F.lit, FLOATS), *drawn]])


def input_vectors(values: Column, count: int = 6) -> Column:
    """Vectors that take each parameter's next value, over and over; no two alike.
    values: an array for each parameter. No parameters are one empty vector."""
    turn = lambda i: F.transform(values, lambda v: F.element_at(v, (i % F.size(v)).cast("int") + 1))
    return F.when(F.size(values) == 0, F.array(F.array().cast("array<bigint>"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), turn)))


#: Fixed: last parts of the names of initialisers.
CONSTRUCTORS = ("init", "new", "create", "setup", "start", "open", "alloc", "initialize", "initialise", "init_static", "reset")


def candidate_names(name: Column) -> Column:
    """Names of the initialisers that would go with a name; none for an initialiser."""
    head, tail = F.regexp_extract(name, "^(.+)_([^_]+)$", 1), F.regexp_extract(name, "^(.+)_([^_]+)$", 2)
    every = F.transform(F.array(*map(F.lit, CONSTRUCTORS)), lambda s: F.concat(head, F.lit("_"), s))
    return F.when((head != "") & ~tail.isin(*CONSTRUCTORS), every).otherwise(F.array().cast("array<string>"))


def chainable(abi: Column) -> Column:
    """Whether a function may initialise another's first argument."""
    first = F.get(abi["params"], 0)["kind"] == "pointer"
    rest = F.forall(F.slice(abi["params"], F.lit(2), F.greatest(F.size(abi["params"]), F.lit(1))), lambda p: p["kind"] == "int")
    return F.coalesce(~F.coalesce(abi["variadic"], F.lit(False)) & first & rest, F.lit(False))


def returns_context(abi: Column) -> Column:
    """Whether a function makes what another's first argument points to."""
    return F.coalesce(~F.coalesce(abi["variadic"], F.lit(False)) & (abi["return"]["kind"] == "pointer") & F.forall(abi["params"], lambda p: p["kind"] == "int"), F.lit(False))
