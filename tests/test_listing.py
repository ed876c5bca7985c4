import pytest
from pyspark.sql import functions as F

from quernstone.functions import listing


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_register_classes(spark):
    names = ["RAX", "rip", "eax", "sp", "sil", "r8", "R10D", "r15w", "r9b", "r7", "r16", "xmm3", "ymm0", "fs", "foo", "r8x"]
    want = ["REG64", "REG64", "REG32", "REG16", "REG8", "REG64", "REG32", "REG16", "REG8", None, None, "VEC", "VEC", "SEG", None, None]
    assert column(spark, names, listing.register_class) == want


def test_immediate_classes(spark):
    values = ["0", "1", "-8", "0x1000", "0x401230", "255", "256", "0xff", "0x100", "65535", "65536", "0x0000ffff", "-0x0", "0xFFFFFFFFFFFFFFFFFF", "9" * 40, "x"]
    want = ["ZERO", "SMALL", "SMALL", "MED", "LARGE", "SMALL", "MED", "SMALL", "MED", "MED", "LARGE", "MED", "ZERO", "LARGE", "LARGE", None]
    assert column(spark, values, listing.immediate_class) == [w and f"IMM_{w}" for w in want]


def test_memory_classes(spark):
    inside = ["RBP+-0x18", "rip+0x20", "0x401000", "RAX+RCX*0x4", "RAX", "RAX+0x8", "RAX+0x0", "ESP"]
    assert column(spark, inside, listing.memory_class) == [f"MEM_{x}" for x in ("STACK", "GLOBAL", "GLOBAL", "INDEXED", "REG", "FIELD", "REG", "STACK")]


def test_targets(spark):
    targets = ["", None, "IMPORT:KERNEL32.dll!ReadFile", "IMPORT:ReadFile", "LOCAL:-0x4", "LOCAL:0x4", "CALL:internal", "CALL:indirect", "CALL:what", "TAIL:internal", "TAIL:x", "else"]
    want = [None, None, "IMPORT:ReadFile", "IMPORT:ReadFile", "BB_BACK", "BB_FWD", "FUNC_INTERNAL", "FUNC_INDIRECT", "FUNC_UNKNOWN", "TAIL_INTERNAL", "TAIL_UNKNOWN", "FUNC_UNKNOWN"]
    assert column(spark, targets, listing.target_token) == want


@pytest.mark.parametrize(
    "lines, want",
    [
        ("0\tmov\tRAX qwordptr[RBP+-0x18]\t", "mov REG64 MEM_STACK"),
        ("0\tjmp\t0x401000\tLOCAL:0x10", "jmp BB_FWD"),
        ("0\tcall\t0x401000\tIMPORT:KERNEL32.dll!CreateFileW", "call IMPORT:CreateFileW"),
        ("0\tcall\t0x401000\tCALL:internal", "call FUNC_INTERNAL"),
        ("0\tcall\tqwordptr[0x404000]\tCALL:internal", "call MEM_GLOBAL FUNC_INDIRECT"),
        ("0\tcall\tRAX\tCALL:indirect", "call REG64 FUNC_INDIRECT"),
        ("0\tret\t\t", "ret"),
        ("0\tnop\t\n \n1\tcmp\tEAX 0x1000\t\n\n", "cmp REG32 IMM_MED"),
        ("", ""),
        (None, ""),
    ],
)
def test_listings(spark, lines, want):
    assert column(spark, [lines], lambda v: F.array_join(listing.tokens(v), " ")) == [want]


def test_views_of_a_listing(spark):
    text = "0\tcall\tx\tIMPORT:K.dll!A\n1\tmov\n2\tcall\tx\tIMPORT:B\n3\tjmp\tx\tTAIL:internal\n4\tcall\tx\tIMPORT:L.dll!A"
    assert column(spark, [text], lambda v: listing.mnemonics(v)) == [["call", "mov", "call", "jmp", "call"]]
    assert column(spark, [text], lambda v: listing.mnemonics(v, 4)) == [["call", "call", "jmp", "call"]]
    assert column(spark, [text], listing.import_set) == [["A", "B"]]
    assert column(spark, [text], listing.call_count) == [4]


def test_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(listing.ngrams(F.col("t"))).collect()] == [["a b c", "b c d"], ["a"], []]
