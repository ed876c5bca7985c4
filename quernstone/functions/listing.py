"""Tokens of instruction listings as column expressions.

A listing is text: a line for each instruction, with four fields between tabs,
offset, mnemonic, operands (between spaces) and target. Everything here is built
from native functions and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Register names by width, and the kinds of targets left open.
REGISTERS = {
    "REG64": ["rax", "rbx", "rcx", "rdx", "rsi", "rdi", "rbp", "rsp", "rip"],
    "REG32": ["eax", "ebx", "ecx", "edx", "esi", "edi", "ebp", "esp"],
    "REG16": ["ax", "bx", "cx", "dx", "si", "di", "bp", "sp"],
    "REG8": ["al", "bl", "cl", "dl", "ah", "bh", "ch", "dh", "sil", "dil", "bpl", "spl"],
    "SEG": ["cs", "ds", "es", "fs", "gs", "ss"],
}
STACK_REGISTERS = ["rbp", "rsp", "ebp", "esp"]
OPEN_TARGETS = ["FUNC_INDIRECT", "FUNC_UNKNOWN", "TAIL_UNKNOWN"]
SIZE_PREFIX = "^(?:byte|word|dword|qword|tbyte|xmmword|ymmword|zmmword)ptr"
LITERAL = "(?i)^-?(?:0x[0-9a-f]+|[0-9]+)$"


def register_class(name: Column) -> Column:
    """The width class of a register, or null for what is none."""
    low = F.lower(name)
    out = F.when(low.rlike("^[xyz]mm"), "VEC")
    for kind, names in REGISTERS.items():
        out = out.when(low.isin(names), kind)
    numbered = r"^r0*(?:[89]|1[0-5])"
    for suffix, kind in (("", "REG64"), ("d", "REG32"), ("w", "REG16"), ("b", "REG8")):
        out = out.when(low.rlike(f"{numbered}{suffix}$"), kind)
    return out


def is_literal(text: Column) -> Column:
    return text.rlike(LITERAL)


def immediate_class(text: Column) -> Column:
    """The magnitude class of a literal, or null for what is none. Digits are
    compared as text, so no literal is too long."""
    low = F.lower(F.regexp_replace(text, "^-", ""))
    hexadecimal = low.startswith("0x")
    digits = F.regexp_replace(F.when(hexadecimal, F.substring(low, 3, 1 << 20)).otherwise(low), "^0+", "")
    long = F.length(digits)

    def upto(hex_digits: int, limit: str) -> Column:
        decimal = (long < len(limit)) | ((long == len(limit)) & (digits <= limit))
        return F.when(hexadecimal, long <= hex_digits).otherwise(decimal)

    return F.when(is_literal(text), F.when(digits == "", "IMM_ZERO").when(upto(2, "255"), "IMM_SMALL").when(upto(4, "65535"), "IMM_MED").otherwise("IMM_LARGE"))


def memory_class(inside: Column) -> Column:
    """The class of what stands between the brackets of a memory operand."""
    parts = F.filter(F.split(inside, r"[+\-*]"), lambda p: p != "")
    registers = F.filter(parts, lambda p: register_class(p).isNotNull())
    moved = F.exists(parts, lambda p: register_class(p).isNull() & is_literal(p) & (immediate_class(p) != "IMM_ZERO"))
    return (
        F.when(F.exists(registers, lambda r: F.lower(r).isin(STACK_REGISTERS)), "MEM_STACK")
        .when(F.exists(registers, lambda r: F.lower(r) == "rip"), "MEM_GLOBAL")
        .when(inside.contains("*"), "MEM_INDEXED")
        .when(F.size(registers) == 0, "MEM_GLOBAL")
        .when(moved, "MEM_FIELD")
        .otherwise("MEM_REG")
    )


def operand_token(operand: Column) -> Column:
    bare = F.regexp_replace(operand, SIZE_PREFIX, "")
    inside = F.regexp_extract(bare, r"\[(.*)\]", 1)
    return (
        F.when(bare == "", "OP_NONE")
        .when(bare.contains("[") & bare.contains("]"), memory_class(inside))
        .otherwise(F.coalesce(register_class(bare), immediate_class(bare), F.lit("OP_OTHER")))
    )


def target_token(target: Column) -> Column:
    """The token of a call or branch target, or null for no target."""
    kind = F.regexp_extract(target, "^([^:]*)", 1)
    rest = F.regexp_replace(target, "^[^:]*:?", "")
    name = F.regexp_extract(rest, "^[^!]*!(.*)$", 1)
    return F.when(
        F.coalesce(target, F.lit("")) != "",
        F.when(kind == "IMPORT", F.concat(F.lit("IMPORT:"), F.when(name != "", name).otherwise(rest)))
        .when(kind == "LOCAL", F.when(rest.startswith("-"), "BB_BACK").otherwise("BB_FWD"))
        .when((kind == "CALL") & (rest == "internal"), "FUNC_INTERNAL")
        .when((kind == "CALL") & (rest == "indirect"), "FUNC_INDIRECT")
        .when((kind == "TAIL") & (rest == "internal"), "TAIL_INTERNAL")
        .when(kind == "TAIL", "TAIL_UNKNOWN")
        .otherwise("FUNC_UNKNOWN"),
    )


def line_tokens(line: Column) -> Column:
    """The tokens of a line, in order; none with fewer than four fields."""
    fields = F.split(line, "\t", -1)
    mnemonic, operands, target = (F.get(fields, i) for i in (1, 2, 3))
    resolved = target_token(target)
    through_memory = (mnemonic == "call") & (resolved == "FUNC_INTERNAL") & operand_token(F.get(F.split(operands, " ", -1), 0)).startswith("MEM_")
    resolved = F.when(F.coalesce(through_memory, F.lit(False)), "FUNC_INDIRECT").otherwise(resolved)
    shown = resolved.isNull() | resolved.isin(OPEN_TARGETS)
    classes = F.transform(F.filter(F.split(operands, " ", -1), lambda o: o != ""), operand_token)
    none = F.array().cast("array<string>")
    return F.when(F.size(fields) >= 4, F.concat(F.array(mnemonic), F.when(shown, classes).otherwise(none), F.array_compact(F.array(resolved)))).otherwise(none)


def lines(listing: Column) -> Column:
    """The lines that hold something; a null listing has none."""
    return F.filter(F.split(F.coalesce(listing, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def tokens(listing: Column) -> Column:
    return F.flatten(F.transform(lines(listing), line_tokens))


def mnemonics(listing: Column, fields: int = 2) -> Column:
    """Second fields of the lines with at least so many fields. Rankers count lines
    with four fields only, the plain view any with two."""
    parts = F.filter(F.transform(lines(listing), lambda x: F.split(x, "\t", -1)), lambda p: F.size(p) >= fields)
    return F.transform(parts, lambda p: p[1])


def targets(listing: Column) -> Column:
    parts = F.filter(F.transform(lines(listing), lambda x: F.split(x, "\t", -1)), lambda p: F.size(p) >= 4)
    return F.transform(parts, lambda p: p[3])


def import_set(listing: Column) -> Column:
    """Distinct names of imports, without their library."""
    found = F.filter(targets(listing), lambda t: t.startswith("IMPORT:"))

    def name(t: Column) -> Column:
        after = F.regexp_extract(t, "^IMPORT:[^!]*!(.*)$", 1)
        return F.when(after != "", after).otherwise(F.substring(t, 8, 1 << 20))

    return F.array_distinct(F.transform(found, name))


def call_count(listing: Column) -> Column:
    return F.size(F.filter(targets(listing), lambda t: t.rlike("^(?:CALL|IMPORT|TAIL):")))


def content_key(token_list: Column) -> Column:
    """The hash that equal normalised code shares."""
    return F.sha2(F.array_join(token_list, " "), 256)


def ngrams(token_list: Column, n: int = 3) -> Column:
    """Windows of n tokens, joined by spaces; fewer, but not none, are one gram."""
    size = F.size(token_list)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.array_join(F.slice(token_list, i + 1, F.lit(n)), " "))
    return F.when(size > 0, grams).otherwise(F.array().cast("array<string>"))
