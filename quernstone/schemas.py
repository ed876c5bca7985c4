"""Table contracts: schemas, enumerations and the schema version."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 10
#: Fixed values of the data model.
RUN_STATUS = ("running", "ok", "failed")
SPLITS = ("train", "val", "test")
LEVELS = ("O0", "O1", "O2", "O3")
ROLES = ("subject", "target")
#: Kind of entity to the table that holds it.
ENTITY_TABLES = {"function": "functions", "basic_block": "basic_blocks", "string": "strings"}
#: Types of events that the producers emit.
EVENT_TYPES = (
    "observation.function",
    "observation.import",
    "observation.call",
    "observation.basic_block",
    "observation.cfg_edge",
    "observation.string",
    "observation.string_ref",
    "observation.instructions",
)

_TYPES = {"id": T.LongType(), "n": T.IntegerType(), "text": T.StringType(), "flag": T.BooleanType(), "time": T.TimestampType(), "texts": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    """From ``name:type`` words; a type that ends in ! is not nullable."""
    fields = [x.split(":") for x in spec.split()]
    return T.StructType([T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


ABI = T.StructType([
    T.StructField("return", T.StructType([T.StructField("kind", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("signed", T.BooleanType())])),
    T.StructField("params", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("signed", T.BooleanType())]))),
    T.StructField("variadic", T.BooleanType()),
])

TABLES: dict[str, T.StructType] = {
    "runs": _schema("id:id! kind:text! tool:text tool_version:text code_version:text params:text seed:id started_at:time! ended_at:time status:text!"),
    "binaries": _schema("id:id! path:text! sha256:text! arch:text imported_at:time!"),
    "functions": _schema("id:id! binary_id:id! address:id! size:id raw_name:text library:text is_external:flag! is_thunk:flag!"),
    "basic_blocks": _schema("id:id! binary_id:id! function_id:id! address:id! size:id"),
    "strings": _schema("id:id! binary_id:id! address:id! length:id value:text"),
    "corpus_binaries": _schema("binary_id:id! package:text! version:text compiler:text opt_level:text! stripped:flag! twin_id:id"),
    "ground_truth": _schema("id:id! binary_id:id! function_id:id address:id! name:text! return_type:text param_types:texts decl_file:text decl_line:n").add("abi", ABI),
    "function_code": _schema("function_id:id! binary_id:id! n_instructions:n! code_size:id! byte_hash:text! listing:text!"),
    "dataset_split": _schema("package:text! split:text! assigned_at:time"),
    "corpus_gaps": _schema("package:text! opt_level:text! reason:text! recorded_at:time"),
    "measurements": _schema("id:id! run_id:id! split:text! method:text! metrics:text! recorded_at:time"),
    "events": _schema("id:id! binary_id:id! run_id:id! seq:id! created_at:time! type:text! payload:text!"),
    "event_links": _schema("event_id:id! entity_kind:text! entity_id:id! role:text!"),
}

#: Tables that training needs, in the order of their export.
TRAINING_TABLES = ("binaries", "functions", "basic_blocks", "corpus_binaries", "ground_truth", "function_code", "dataset_split")
