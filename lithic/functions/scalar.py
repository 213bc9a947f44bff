"""Scalar rules as column expressions; Catalyst compiles all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOISE_PARTS = ("impl", "inner", "helper", "rs", "c", "cpp")
STRING_TYPES = ("string", "str", "&str", "&'static str", "cstr", "cstring", "osstring", "osstr", "pathbuf", "path", "charsequence")
COLLECTION_STARTS = (
    "vec<", "vec::", "hashmap<", "btreemap<", "hashset<", "btreeset<", "vecdeque<", "linkedlist<", "std::vector", "std::map", "std::set", "std::list", "std::deque",
    "std::array", "std::unordered_map", "std::unordered_set", "list<", "map<", "set<", "arraylist<", "hashtable<", "iterable<", "collection<",
)
COLLECTION_TYPES = ("list", "dict", "set", "tuple", "frozenset", "map", "vector", "arraylist", "hashmap", "btreemap")
POINTER_STARTS = ("box<", "rc<", "arc<", "refcell<", "cell<", "nonnull<", "weak<")
BOOL_TYPES = ("bool", "boolean", "logical", "_bool")
CHAR_TYPES = ("char", "c_char", "u_char", "wchar_t", "char16_t", "char32_t", "character")
FLOAT_TYPES = ("f32", "f64", "float", "double", "long double", "real", "real4", "real8", "real16", "float32", "float64")
INT_TYPES = (
    "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "int", "uint", "short", "long", "byte", "signed", "unsigned", "long long",
    "unsigned int", "unsigned short", "unsigned long", "unsigned long long", "signed int", "signed short", "signed long", "size_t", "ssize_t", "ptrdiff_t", "intptr_t",
    "uintptr_t", "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "c_int", "c_uint", "c_short", "c_ushort", "c_long", "c_ulong",
    "c_longlong", "c_ulonglong", "c_size_t", "c_ssize_t", "integer", "integer*1", "integer*2", "integer*4", "integer*8",
)
#: Extension of a file name to the language of the file.
EXTENSIONS = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rs": "rust", "java": "java", "py": "python", "pyi": "python",
    "r": "r", "pl": "perl", "pm": "perl", "t": "perl", "f": "fortran", "for": "fortran", "f77": "fortran", "f90": "fortran", "f95": "fortran", "f03": "fortran", "f08": "fortran",
}

any_of = lambda tests: reduce(lambda a, b: a | b, tests)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalize_name(name: Column) -> Column:
    """camelCase and `::` become `_`, lower case, without parts that only say which side a name is from."""
    spread = ascii_lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    parts = F.split(F.replace(spread, F.lit("::"), F.lit("_")), "_")
    return F.array_join(F.filter(parts, lambda p: (p != "") & ~p.isin(*NOISE_PARTS)), "_")


def name_tokens(name: Column) -> Column:
    return F.split(normalize_name(name), "_")


def share_token(a: Column, b: Column, least: int = 4) -> Column:
    """Two token lists have one of at least four bytes in common."""
    return F.coalesce(F.arrays_overlap(F.filter(a, lambda t: F.octet_length(t) >= least), b), F.lit(False))


def bucket_log(loc: Column) -> Column:
    """floor(log2(loc)), 0 for 0."""
    n = loc.cast("long")
    return F.when(n <= 0, 0).otherwise(F.length(F.bin(n)) - 1)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def path_suffix_matches(path: Column, suffix: Column) -> Column:
    """The last whole components of path are those of suffix; no or an empty suffix fits all."""
    have, want = path_parts(path), path_parts(F.coalesce(suffix, F.lit("")))
    n = F.size(want)
    return F.when(n == 0, True).when(n > F.size(have), False).otherwise(F.slice(have, F.greatest(F.size(have) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == want)


def class_matches(own: Column, want: Column) -> Column:
    """No demand fits all, an empty one only functions outside any class."""
    return F.when(want.isNull(), True).when(want == "", own.isNull()).otherwise(F.coalesce(own == want, F.lit(False)))


def line_matches(line: Column, want: Column) -> Column:
    return want.isNull() | (line == want)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def classify_type(ty: Column) -> Column:
    """Category of a type's text; the order of the tests matters."""
    t = F.trim(ty)
    low = ascii_lower(t)
    bare = F.trim(F.regexp_replace(low, "^&+", ""))
    has, starts = lambda x: low.contains(x), lambda x: low.startswith(x)
    string = any_of([bare.isin(*STRING_TYPES), bare.startswith("string"), bare.startswith("std::string"), bare.endswith("::string"), bare.contains("char *"), bare.contains("char*"), bare.contains("c_char"), bare.contains("character(len"), bare.startswith("character*")])
    array = any_of([t.endswith("]"), has("dimension("), has(", dimension")])
    collection = any_of([low.isin(*COLLECTION_TYPES), *[starts(p) | has(f" {p}") for p in COLLECTION_STARTS]])
    pointer = any_of([t.contains("*"), t.startswith("&"), *[starts(p) for p in POINTER_STARTS]])
    return (
        F.when(t == "", "other").when(string, "string").when(array, "array").when(collection, "collection").when(pointer, "pointer").when(low.isin(*BOOL_TYPES), "bool")
        .when(low.isin(*CHAR_TYPES), "char").when(low.isin(*FLOAT_TYPES) | starts("real(") | starts("complex("), "float").when(low.isin(*INT_TYPES) | starts("integer("), "int").otherwise("other")
    )


def parse_int(text: Column) -> Column:
    """A literal's value with radix prefix, separators and suffix, as a signed 64-bit number (unsigned ones wrap); null if none."""
    t = F.regexp_replace(F.trim(text), "[_']", "")
    negative = t.startswith("-")
    body = F.regexp_replace(t, "^[+-]", "")
    digits = (
        F.when(body.rlike("^0[xX]"), F.conv(F.regexp_extract(body, "^0[xX]([0-9a-fA-F]+)", 1), 16, -10))
        .when(body.rlike("^0[bB]"), F.conv(F.regexp_extract(body, "^0[bB]([01]+)", 1), 2, -10))
        .when(body.rlike("^0[oO]"), F.conv(F.regexp_extract(body, "^0[oO]([0-7]+)", 1), 8, -10))
        .when(body.rlike("^[0-9]"), F.conv(F.regexp_extract(body, "^([0-9]+)", 1), 10, -10))
    )
    value = digits.try_cast("bigint")
    return F.when(negative & (value != -(2**63)), -value).otherwise(value)


def parse_float(text: Column) -> Column:
    t = F.regexp_replace(text, "[fFLldD]+$", "")
    return F.when(~t.rlike("^[+-]?0[xX]"), t.try_cast("double"))


def constant_display(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), c["str_value"], F.lit('"'))
    return (
        F.when(c["kind"] == "int", F.coalesce(c["text"], c["int_value"].cast("string"))).when(c["kind"] == "float", F.coalesce(c["text"], c["float_value"].cast("string")))
        .when(c["kind"] == "string", quoted).when(c["kind"] == "char", F.concat(F.lit("'"), c["str_value"], F.lit("'"))).otherwise(c["bool_value"].cast("string"))
    )


def halstead_volume(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> Column:
    return F.when(n1 + n2 > 0, (big_n1 + big_n2) * F.log2((n1 + n2).cast("double"))).otherwise(0.0)


def halstead_difficulty(n1: Column, n2: Column, big_n2: Column) -> Column:
    return F.when(n2 > 0, (n1 / F.lit(2.0)) * (big_n2 / n2.cast("double"))).otherwise(0.0)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(1e-9))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def qualified_name(cls: Column, name: Column) -> Column:
    return F.concat_ws("::", cls, name)


def file_tail(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def is_constructor(name: Column) -> Column:
    cls, fn = name_halves(name)
    return (cls != "") & (cls == fn)


def is_destructor(name: Column) -> Column:
    cls, fn = name_halves(name)
    return name.contains("::") & (fn == F.concat(F.lit("~"), cls))


def name_halves(name: Column) -> tuple[Column, Column]:
    """Before and after the last `::`; the first is empty without one."""
    fn = F.substring_index(name, "::", -1)
    return F.when(name.contains("::"), F.substring(name, F.lit(1), F.length(name) - F.length(fn) - 2)).otherwise(""), fn


def summary_line(path: Column, language: Column, n: Column) -> Column:
    return F.format_string("%s: %s %d functions", path, F.initcap(language), n)
