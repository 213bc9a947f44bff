"""Schemas of reports, and reading and flattening them.

A report holds the functions and structs of one code base. Position in it (`idx`) is a function's identity; across operators it
is (name, file, line_start). Reports are read with these schemas, never by inference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: The 17 metrics of a function in the order in which every comparison lists them.
METRICS = (
    "loc_code", "loc_comments", "branches", "loops", "max_loop_nesting", "max_if_nesting", "max_combined_nesting", "calls_unique",
    "calls_total", "cyclomatic", "cognitive", "halstead_volume", "halstead_difficulty", "early_returns", "goto_count", "inputs", "outputs",
)
#: The 10 metrics of a struct, likewise.
STRUCT_METRICS = ("field_count", "int_count", "float_count", "bool_count", "char_count", "string_count", "pointer_count", "array_count", "collection_count", "other_count")

LOCATION = "struct<file:string,line_start:int,line_end:int,col_start:int,col_end:int,byte_start:int,byte_end:int>"
HALSTEAD = "struct<n1:int,n2:int,big_n1:int,big_n2:int,volume:double,difficulty:double>"
FUNCTION_METRICS = (
    "struct<loc_code:int,loc_comments:int,loc_asm:int,inputs:int,outputs:int,branches:int,loops:int,max_loop_nesting:int,max_if_nesting:int,"
    f"max_combined_nesting:int,calls_unique:int,calls_total:int,cyclomatic:int,cognitive:int,halstead:{HALSTEAD},early_returns:int,goto_count:int,unsafe_blocks:int>"
)
#: One struct for all kinds of constants; only the value of its kind is set.
CONSTANT = "struct<kind:string,int_value:bigint,float_value:double,str_value:string,bool_value:boolean,text:string,span:array<int>>"
SIGNATURE = "struct<inputs:array<struct<name:string,ty:struct<text:string>>>,outputs:array<struct<text:string>>>"
FUNCTION = (
    f"name string, original_name string, mangled string, enclosing_type string, location {LOCATION}, signature {SIGNATURE}, metrics {FUNCTION_METRICS}, "
    f"constants array<{CONSTANT}>, calls array<struct<callee:string,count:int,span:array<int>>>, types_used array<struct<text:string>>, attributes map<string,string>"
)
STRUCT = (
    f"name string, kind string, location {LOCATION}, fields array<struct<name:string,ty:struct<text:string>,category:string>>, "
    f"metrics struct<{','.join(f'{m}:int' for m in STRUCT_METRICS)}>, attributes map<string,string>"
)
FUNCTIONS = f"report_id string, idx int, {FUNCTION}"
STRUCTS = f"report_id string, idx int, {STRUCT}"


def nested(ddl: str) -> str:
    """The same columns as one struct type."""
    return "struct<" + ", ".join(x.replace(" ", ":", 1) for x in ddl.split(", ")) + ">"


#: As a JSON document has it: a constant's `value` is of any type there, so it is read as text and dealt to its column.
RAW_CONSTANT = "struct<kind:string,value:string,text:string,span:array<int>>"
REPORT = f"schema_version int, language string, source_file string, source_hash string, functions array<{nested(FUNCTION).replace(CONSTANT, RAW_CONSTANT)}>, structs array<{nested(STRUCT)}>"


def typed_constant(c: Column) -> Column:
    kind = c["kind"]
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "int", c["value"].try_cast("bigint")).alias("int_value"),
        F.when(kind == "float", c["value"].try_cast("double")).alias("float_value"),
        F.when(kind.isin("string", "char"), c["value"]).alias("str_value"),
        F.when(kind == "bool", c["value"].try_cast("boolean")).alias("bool_value"),
        c["text"].alias("text"),
        c["span"].alias("span"),
    )


def functions_of(reports: DataFrame) -> DataFrame:
    """A row a function from raw report rows (`report_id` and the fields of REPORT)."""
    each = reports.select("report_id", F.posexplode("functions").alias("idx", "f"))
    names = [x.split()[0] for x in FUNCTION.split(", ")]
    value = lambda n: F.transform(F.col("f.constants"), typed_constant).alias(n) if n == "constants" else F.col(f"f.{n}")
    return each.select("report_id", "idx", *[value(n) for n in names])


def structs_of(reports: DataFrame) -> DataFrame:
    each = reports.select("report_id", F.posexplode("structs").alias("idx", "s"))
    return each.select("report_id", "idx", "s.*")


def flat(functions: DataFrame) -> DataFrame:
    """One column for each thing that analyses use; `idx` is the position in the report."""
    special = {"halstead_volume": F.col("metrics.halstead.volume"), "halstead_difficulty": F.col("metrics.halstead.difficulty")}
    return functions.select(
        "idx", "name", "original_name", "enclosing_type", F.col("location.file").alias("file"), F.col("location.line_start").alias("line_start"),
        *[special.get(m, F.col(f"metrics.{m}").cast("double")).alias(m) for m in METRICS],
        F.col("metrics.loc_asm").alias("loc_asm"), F.col("metrics.unsafe_blocks").alias("unsafe_blocks"),
        F.size("signature.inputs").alias("arity"), F.size("signature.outputs").alias("outputs_count"),
        F.col("signature.inputs.ty.text").alias("input_types"), "constants", "calls", F.size("types_used").alias("types_used"),
    )
