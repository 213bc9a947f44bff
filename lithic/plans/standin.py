"""Deterministic stand-ins for reports over the driver's tables, which hold no source code.

Each is SQL text that Spark and DuckDB read alike; `{table}` names a table. Metrics are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "replace(p_name, ' ', '_') || '_' || p_partkey"
#: Left names: a third like the right ones, a third in camel case, a third that only shares tokens.
LEFT_NAME = f"""CASE p_partkey % 3 WHEN 0 THEN {BASE}
 WHEN 1 THEN split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || '_' || p_partkey
 ELSE 'new_' || split_part(p_name, ' ', 2) || '_' || p_partkey END"""
EXT = "CASE p_size % 8 WHEN 0 THEN 'c' WHEN 1 THEN 'rs' WHEN 2 THEN 'java' WHEN 3 THEN 'py' WHEN 4 THEN 'R' WHEN 5 THEN 'pl' WHEN 6 THEN 'f90' ELSE 'cpp' END"


def functions_sql(flag: str) -> str:
    name = LEFT_NAME if flag == "A" else BASE
    original = f"CASE WHEN p_partkey % 7 = 0 THEN {BASE} END" if flag == "A" else "CAST(NULL AS VARCHAR(99))"
    return f"""SELECT CAST(p_partkey AS BIGINT) AS idx, {name} AS name, {original} AS original_name, CASE WHEN p_size % 4 = 0 THEN p_brand END AS enclosing_type,
 '/src/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '.' || {EXT} AS file, CAST(p_partkey % 1000 + 1 AS INT) AS line_start, p_name AS plain_name,
 m.*, CAST(p_size % 6 AS DOUBLE) AS inputs, CAST(p_partkey % 2 AS DOUBLE) AS outputs, CAST(p_size % 6 AS INT) AS arity, CAST(p_partkey % 2 AS INT) AS outputs_count,
 CAST(p_partkey % 11 / 10 AS INT) AS loc_asm
FROM {{part}} JOIN (SELECT l_partkey,
  CAST(sum(l_quantity) AS DOUBLE) AS loc_code, CAST(max(l_linenumber) AS DOUBLE) AS loc_comments, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) AS branches,
  CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) AS loops, CAST(min(l_linenumber) AS DOUBLE) AS max_loop_nesting, CAST(max(l_linenumber) - min(l_linenumber) AS DOUBLE) AS max_if_nesting,
  CAST(max(l_linenumber) AS DOUBLE) AS max_combined_nesting, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS calls_unique, CAST(count(*) AS DOUBLE) AS calls_total,
  CAST(1 + sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) AS cyclomatic,
  CAST(sum(CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END) + sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) AS cognitive,
  CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS halstead_volume, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS halstead_difficulty,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS early_returns, CAST(sum(CASE WHEN l_quantity >= 48 THEN 1 ELSE 0 END) AS DOUBLE) AS goto_count
 FROM {{lineitem}} WHERE l_returnflag = '{flag}' GROUP BY l_partkey) m ON p_partkey = l_partkey"""


LEFT, RIGHT = functions_sql("A"), functions_sql("R")
#: Calls by name: a part calls the next line of an order, by plain name (ambiguous) or full name, sometimes a name that nobody has.
CALLS = f"""SELECT DISTINCT CAST(a.l_partkey AS BIGINT) AS idx, CASE WHEN a.l_partkey % 5 = 0 THEN p_name WHEN a.l_partkey % 5 = 1 THEN 'libc_' || b.l_partkey ELSE {BASE} END AS callee
FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN {{part}} ON p_partkey = b.l_partkey"""
#: Vertices of the call graph: every fifth part goes by its plain name, so names repeat.
VERTICES = f"SELECT CAST(p_partkey AS BIGINT) AS idx, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE {BASE} END AS name, '/src/' || p_brand AS file, CAST(p_partkey % 1000 + 1 AS INT) AS line_start FROM {{part}}"
#: Each part calls one other: by size its neighbour (two that do so call each other), one by a jump, or one with a third of its number; the right side differs for some.
JUMP = "CASE WHEN p_size > 40 THEN (p_partkey + 1 - 2 * (p_partkey % 2)) % (SELECT count(*) FROM {{part}}) WHEN p_size > 35 THEN (p_partkey * 7 + 3 + {0}) % (SELECT count(*) FROM {{part}}) ELSE floor((p_partkey + {0}) / 3) END"
GRAPH_LEFT = f"SELECT CAST(p_partkey AS BIGINT) AS src, CAST({JUMP.format('0')} AS BIGINT) AS dst FROM {{part}}"
GRAPH_RIGHT = f"SELECT CAST(p_partkey AS BIGINT) AS src, CAST({JUMP.format('CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END')} AS BIGINT) AS dst FROM {{part}}"
#: Names of the left graph: one part in four has a name of its own, so no counterpart on the right.
OWN_NAMES = f"SELECT CAST(p_partkey AS BIGINT) AS idx, CASE WHEN p_partkey % 4 = 0 THEN 'left_' || p_partkey ELSE {BASE} END AS name FROM {{part}}"
BASE_NAMES = f"SELECT CAST(p_partkey AS BIGINT) AS idx, {BASE} AS name FROM {{part}}"
#: Four parts in a row call each other in a ring, the small ones the first of the four, so each block has one group of one to four.
RINGS = "SELECT CAST(p_partkey AS BIGINT) AS src, CAST(p_partkey - p_partkey % 4 + CASE WHEN p_size > 10 THEN (p_partkey % 4 + 1) % 4 ELSE 0 END AS BIGINT) AS dst FROM {part}"
#: A forest: each vertex calls one with a third of its number, the first one nobody, so there are no cycles.
FOREST = "SELECT DISTINCT CAST(p_partkey AS BIGINT) AS src, CAST(CASE WHEN p_partkey = 0 THEN -1 ELSE floor(p_partkey / 3) END AS BIGINT) AS dst FROM {part}"
#: Constants of pairs: an event type is a pair of sides.
CONSTANTS = """SELECT CAST(user_id AS BIGINT) AS pair_idx, CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS side,
 CASE WHEN event_id % 4 = 0 THEN 'string' ELSE 'int' END AS kind, CAST(CAST(floor(value) AS BIGINT) % 20 AS VARCHAR(99)) AS value FROM {events}"""
TYPES = ("int", "f64", "bool", "char", "String", "char *", "Vec<u8>", "[u8; 4]", "Option<T>", "std::map<int,int>", "const int", "&str", "Box<T>", "real(8)", "integer*4", "dimension(3)", "unsigned char *", "dict", "long double", "HashMap<K,V>")
FIELDS = f"""SELECT p_brand AS name, CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % {len(TYPES)} {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))} END AS type, p_size FROM {{part}}"""
LITERALS = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR(99)) WHEN 1 THEN '-' || o_orderkey WHEN 2 THEN '1_' || o_orderkey || 'u32'
 WHEN 3 THEN o_orderkey || 'UL' WHEN 4 THEN 'x' || o_orderkey ELSE '  ' || o_orderkey END AS text FROM {orders}"""
PROGRESS = f"""SELECT CASE WHEN p_size % 3 = 0 THEN {BASE} ELSE 'gone_' || p_partkey END AS name, '/src/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '.' || {EXT} AS file,
 CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS translated, p_partkey AS row_no FROM {{part}}"""
FLOATS = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '.5' WHEN 1 THEN '-' || o_orderkey || '.25f' WHEN 2 THEN o_orderkey || 'e2' WHEN 3 THEN '0x' || o_orderkey
 WHEN 4 THEN 'x' || o_orderkey ELSE o_orderkey || '.0D' END AS text FROM {orders}"""
RADIX = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 4 WHEN 0 THEN '0x' || hex(o_orderkey) WHEN 1 THEN '-0X' || lower(hex(o_orderkey)) || 'u' WHEN 2 THEN '0b' || bin(o_orderkey) ELSE '0o' || (o_orderkey % 8) END AS text,
 CASE o_orderkey % 4 WHEN 1 THEN -o_orderkey WHEN 3 THEN o_orderkey % 8 ELSE o_orderkey END AS value FROM {orders}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")


def frame(spark: SparkSession, sf_dir: str, sql: str, shuffled: tuple[str, ...] = ()) -> DataFrame:
    """shuffled: tables whose joins are not to be broadcasts, however small their files are."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: rows.hint("merge") if t in shuffled else rows for t, rows in used.items()})


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})
