"""Queries of the analytics engine by name, with their DuckDB equivalents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..common import cut
from ..functions import scalar
from ..model import METRICS, STRUCT_METRICS
from ..operators import callgraph, comparing, matching, prediction
from . import standin
from .standin import duck, frame

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

L = lambda spark, d: frame(spark, d, standin.LEFT, ("part",))
R = lambda spark, d: frame(spark, d, standin.RIGHT, ("part",))


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


# DuckDB forms of the scalar rules.
NORM = "array_to_string(list_filter(string_split(replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '::', '_'), '_'), lambda p : p NOT IN ('', 'impl', 'inner', 'helper', 'rs', 'c', 'cpp')), '_')"
NORM_NAME = NORM.format("name")
WITH = f"WITH RECURSIVE l AS ({duck(standin.LEFT)}), r AS ({duck(standin.RIGHT)})"
FFI = """zl AS (SELECT idx, original_name AS k, row_number() OVER (PARTITION BY original_name ORDER BY idx) AS n FROM l WHERE original_name IS NOT NULL),
 zr AS (SELECT idx, name AS k, row_number() OVER (PARTITION BY name ORDER BY idx) AS n FROM r),
 ffi AS (SELECT zl.idx AS left_idx, zr.idx AS right_idx FROM zl JOIN zr USING (k, n))"""
EXACT = """l1 AS (SELECT * FROM l WHERE idx NOT IN (SELECT left_idx FROM ffi)), r1 AS (SELECT * FROM r WHERE idx NOT IN (SELECT right_idx FROM ffi)),
 exact AS (SELECT a.left_idx, b.right_idx FROM (SELECT name, min(idx) AS left_idx FROM l1 GROUP BY name) a JOIN (SELECT name, max(idx) AS right_idx FROM r GROUP BY name) b USING (name) WHERE b.right_idx IN (SELECT idx FROM r1))"""
NORMALIZED = f"""l2 AS (SELECT * FROM l1 WHERE idx NOT IN (SELECT left_idx FROM exact)), r2 AS (SELECT * FROM r1 WHERE idx NOT IN (SELECT right_idx FROM exact)),
 nl AS (SELECT idx, {NORM_NAME} AS k, row_number() OVER (PARTITION BY {NORM_NAME} ORDER BY idx) AS n FROM l2), nr AS (SELECT idx, {NORM_NAME} AS k, row_number() OVER (PARTITION BY {NORM_NAME} ORDER BY idx) AS n FROM r2),
 normalized AS (SELECT nl.idx AS left_idx, nr.idx AS right_idx FROM nl JOIN nr USING (k, n))"""
PAIRS = f"""{FFI}, {EXACT}, {NORMALIZED},
 staged AS (SELECT 1 AS s, *, 'FfiAttribute' AS strategy FROM ffi UNION ALL SELECT 2, *, 'ExactName' FROM exact UNION ALL SELECT 3, *, 'Normalized' FROM normalized),
 pairs AS (SELECT row_number() OVER (ORDER BY s, left_idx) - 1 AS pair_idx, left_idx, right_idx, strategy FROM staged)"""
#: The stages whose result does not depend on which of several candidates comes first.
SET_STAGES = ("FfiAttribute", "ExactName", "Normalized")
NAMED = ("idx", "name", "original_name")


def sides(spark, d, left=METRICS, right=METRICS):
    """Both sides with their names and the columns given, written once: the stages and what follows them read them many times."""
    return tuple(cut(make(spark, d).select(*dict.fromkeys((*NAMED, *more)))) for make, more in ((L, left), (R, right)))


def pairs_of(a, b):
    """The pairs of two sides, written once."""
    return cut(matching.match(a, b, None, SET_STAGES))


def paired_sides(spark, d, left=METRICS, right=METRICS):
    a, b = sides(spark, d, left, right)
    return pairs_of(a, b), a, b



def p95_sql(metrics=METRICS, tables=("l", "r")) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM {t}" for m in metrics for t in tables)
    return f"vals AS ({each}), rk AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) AS n, count(*) OVER (PARTITION BY metric) AS c FROM vals), scale AS (SELECT metric, greatest(v, 1.0) AS scale FROM rk WHERE n = CAST(round((c - 1) * 0.95::DOUBLE) AS BIGINT) + 1)"


def total_sql(metrics=METRICS, weights=comparing.WEIGHTS) -> str:
    return " + ".join(f"{weights.get(m, 1.0)} * abs(a.{m} - b.{m}) / (SELECT scale FROM scale WHERE metric = '{m}')" for m in metrics)


# --- names, paths, types, literals


@query(f"{WITH} SELECT idx, name, {NORM_NAME} AS normalized FROM l")
def normalize_name(spark, d):
    return L(spark, d).select("idx", "name", scalar.normalize_name(F.col("name")).alias("normalized"))


@query(f"{WITH} SELECT idx, ends_with(file, '/' || replace(plain_name, ' ', '_') || '.c') AS matches, regexp_extract(file, '\\.([^./]+)$', 1) AS ext FROM r")
def path_suffix(spark, d):
    want = F.concat(F.replace("plain_name", F.lit(" "), F.lit("_")), F.lit(".c"))
    return R(spark, d).select("idx", scalar.path_suffix_matches(F.col("file"), want).alias("matches"), F.regexp_extract("file", r"\.([^./]+)$", 1).alias("ext"))


KNOWN_TYPES = dict(zip(standin.TYPES, ("int", "float", "bool", "char", "string", "string", "collection", "array", "other", "collection", "other", "string", "pointer", "float", "pointer", "array", "string", "collection", "float", "collection")))


@query(f"WITH f AS ({duck(standin.FIELDS)}) SELECT ord, type, CASE type {' '.join(f'''WHEN '{t}' THEN '{c}' ''' for t, c in KNOWN_TYPES.items())} END AS category FROM f")
def classify_type(spark, d):
    return frame(spark, d, standin.FIELDS).select("ord", "type", scalar.classify_type(F.col("type")).alias("category"))


@query(f"WITH t AS ({duck(standin.LITERALS)}) SELECT id, TRY_CAST(regexp_extract(replace(trim(text), '_', ''), '^(-?[0-9]+)', 1) AS BIGINT) AS value FROM t")
def parse_int(spark, d):
    return frame(spark, d, standin.LITERALS).select("id", scalar.parse_int(F.col("text")).alias("value"))


@query(f"{WITH} SELECT idx, CASE WHEN loc_code <= 0 THEN 0 ELSE CAST(length(bin(CAST(loc_code AS BIGINT))) - 1 AS INT) END AS bucket, list_has_any(list_filter(string_split({NORM_NAME}, '_'), lambda t : strlen(t) >= 4), string_split(replace(plain_name, ' ', '_'), '_')) AS shares FROM l")
def fingerprint_parts(spark, d):
    return L(spark, d).select("idx", scalar.bucket_log(F.col("loc_code")).alias("bucket"), scalar.share_token(scalar.name_tokens(F.col("name")), F.split(F.replace("plain_name", F.lit(" "), F.lit("_")), "_")).alias("shares"))


@query(f"{WITH}, x AS (SELECT lower(regexp_extract(file, '\\.([^./]+)$', 1)) AS e FROM r), y AS (SELECT CASE e WHEN 'c' THEN 'c' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'r' THEN 'r' WHEN 'pl' THEN 'perl' WHEN 'f90' THEN 'fortran' ELSE 'cpp' END AS language FROM x) SELECT language, count(*) AS n FROM y WHERE language <> 'rust' GROUP BY language ORDER BY n DESC, language LIMIT 1")
def dominant_language(spark, d):
    from ..sources import files

    return files.dominant_language(R(spark, d).select(F.col("file").alias("path")))


# --- matching


@query(f"{WITH}, {FFI} SELECT * FROM ffi")
def match_ffi(spark, d):
    return matching.match_ffi(L(spark, d), R(spark, d))


@query(f"{WITH}, a AS (SELECT plain_name AS k, min(idx) AS left_idx FROM l GROUP BY 1), b AS (SELECT plain_name AS k, max(idx) AS right_idx FROM r GROUP BY 1) SELECT left_idx, right_idx FROM a JOIN b USING (k)")
def match_exact(spark, d):
    plain = lambda x: x.drop("name").withColumnRenamed("plain_name", "name")
    return matching.match_exact(plain(L(spark, d)), plain(R(spark, d)))


ZIP_NORM = NORM.format("plain_name").replace("replace(lower", "replace(lower", 1)


@query(f"{WITH}, a AS (SELECT idx, {ZIP_NORM} AS k, row_number() OVER (PARTITION BY {ZIP_NORM} ORDER BY idx) AS n FROM l), b AS (SELECT idx, {ZIP_NORM} AS k, row_number() OVER (PARTITION BY {ZIP_NORM} ORDER BY idx) AS n FROM r) SELECT a.idx AS left_idx, b.idx AS right_idx FROM a JOIN b USING (k, n)")
def match_normalized(spark, d):
    plain = lambda x: x.drop("name").withColumnRenamed("plain_name", "name")
    return matching.match_normalized(plain(L(spark, d)), plain(R(spark, d)))


@query()
def match_fingerprint(spark, d):
    return matching.match_fingerprint(L(spark, d), R(spark, d))


#: Each of ten names stands in eight entries: the k-th entry of a name takes the k-th row of either side.
ENTRY_NAMES = ("hot rod", "red plate", "cold gear", "hot widget", "blue ring", "green bolt", "blue bolt", "small ring", "no such", "red gear")
ENTRIES = [{"left": n, "right": n} for _ in range(8) for n in ENTRY_NAMES]
ENTRY_SQL = ", ".join(f"({i}, '{e['left']}', {i // len(ENTRY_NAMES) + 1})" for i, e in enumerate(ENTRIES))
by_plain_name = lambda rows: rows.drop("name").withColumnRenamed("plain_name", "name")


@query(f"{WITH}, e(entry_idx, k, n) AS (VALUES {ENTRY_SQL}), a AS (SELECT idx AS left_idx, plain_name AS k, row_number() OVER (PARTITION BY plain_name ORDER BY idx) AS n FROM l), b AS (SELECT idx AS right_idx, plain_name AS k, row_number() OVER (PARTITION BY plain_name ORDER BY idx) AS n FROM r) SELECT entry_idx, left_idx, right_idx FROM e JOIN a USING (k, n) JOIN b USING (k, n)")
def match_mapping(spark, d):
    return matching.match_mapping(by_plain_name(L(spark, d)), by_plain_name(R(spark, d)), ENTRIES)


@query(f"{WITH}, {PAIRS} SELECT * FROM pairs")
def match_cascade(spark, d):
    return matching.match(*sides(spark, d, (), ()), None, SET_STAGES)


@query()
def match_all_stages(spark, d):
    asked = ("file", "line_start", "enclosing_type", "arity", "outputs_count", "loc_code")
    return matching.match(*sides(spark, d, asked, asked), [{"left": f"new_{w}_{i}", "right": f"{v}_{w}_{i}", "right_path": f"{v}_{w}.{e}"} for i, v, w, e in ((2, "blue", "bolt", "pl"), (5, "small", "ring", "c"))])


# --- comparison


@query(f"{WITH}, {p95_sql()} SELECT * FROM scale")
def p95_scale(spark, d):
    return comparing.p95_scale(L(spark, d).select(*METRICS).unionByName(R(spark, d).select(*METRICS)))


DEVIATION = f"{WITH}, {PAIRS}, {p95_sql()}, dev AS (SELECT pair_idx, a.name AS left_name, b.name AS right_name, {total_sql()} AS total FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx)"


@query(f"{DEVIATION} SELECT pair_idx, left_name, right_name, round(total, 6) AS total FROM dev")
def compare_deviation(spark, d):
    return comparing.deviation(*paired_sides(spark, d)).select("pair_idx", "left_name", "right_name", F.round("total", 6).alias("total"))


@query(f"{DEVIATION} SELECT pair_idx, round(total, 6) AS total FROM dev ORDER BY round(total, 6) DESC, pair_idx LIMIT 20")
def compare_top(spark, d):
    rows = comparing.deviation(*paired_sides(spark, d)).withColumn("total", F.round("total", 6))
    return comparing.ranked_by(rows, "total").select("pair_idx", "total")


@query(f"{WITH}, {PAIRS} SELECT name FROM r WHERE idx NOT IN (SELECT right_idx FROM pairs)")
def missing_right(spark, d):
    pairs, _, b = paired_sides(spark, d, (), comparing.IDENTITY)
    return comparing.missing(b, pairs, "right").select("name")


@query(f"{WITH}, {PAIRS} SELECT name FROM l WHERE idx NOT IN (SELECT left_idx FROM pairs)")
def extra_left(spark, d):
    pairs, a, _ = paired_sides(spark, d, comparing.IDENTITY, ())
    return comparing.missing(a, pairs, "left").select("name")


@query(f"""{WITH}, {PAIRS} SELECT pair_idx, a.name AS left_name, b.name AS right_name, 'left LOC ' || CAST(a.loc_code AS BIGINT) || ' is ' || CAST(round_even(100 * (greatest(a.loc_code, 1) / greatest(b.loc_code, 1)), 0) AS BIGINT) || '% of right LOC ' || CAST(b.loc_code AS BIGINT) AS reason
 FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx WHERE greatest(a.loc_code, 1) / greatest(b.loc_code, 1) < 0.2""")
def partial_stub(spark, d):
    return comparing.partial(*paired_sides(spark, d, ("file", "loc_code"), ("file", "loc_code")))


STATS = ", ".join(f"avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}" for m in comparing.SORT_METRICS)
COMPOSITE = " + ".join(f"({m} - a_{m}) / greatest(s_{m}, 1e-9)" for m in comparing.SORT_METRICS)


@query(f"{WITH}, st AS (SELECT {STATS} FROM r) SELECT idx, round({COMPOSITE}, 6) AS score FROM r, st")
def sort_composite(spark, d):
    return comparing.sort_report(R(spark, d), "composite", None).select("idx", F.round("score", 6).alias("score"))


@query(f"{WITH} SELECT idx, max_combined_nesting * loc_code AS score FROM r ORDER BY score DESC, idx LIMIT 20")
def sort_nesting_x_loc(spark, d):
    return comparing.sort_report(R(spark, d), "nesting-x-loc").select("idx", "score")


@query(f"""WITH c AS ({duck(standin.CONSTANTS)}), k AS (SELECT pair_idx, kind, value, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM c GROUP BY ALL),
 s AS (SELECT pair_idx, kind, sum(greatest(l - r, 0)) AS a, sum(greatest(r - l, 0)) AS b, sum(least(l, r)) AS both_, sum(l) AS l, sum(r) AS r FROM k GROUP BY ALL)
 SELECT pair_idx, CAST(sum(a) AS BIGINT) AS only_left, CAST(sum(b) AS BIGINT) AS only_right, CAST(sum(both_) AS BIGINT) AS in_both, CAST(sum(a + b) + 0.5 * sum(abs(l - r)) AS DOUBLE) AS score FROM s GROUP BY pair_idx""")
def constants_diff(spark, d):
    out = comparing.constants_diff(frame(spark, d, standin.CONSTANTS))
    size = lambda c: F.size(c).cast("long").alias(c)
    return out.select("pair_idx", size("only_left"), size("only_right"), size("in_both"), F.col("score").cast("double").alias("score"))


@query(f"WITH c AS ({duck(standin.CONSTANTS)}) SELECT pair_idx, {', '.join(f'''count(*) FILTER (kind = '{k}') AS n_{k}''' for k in comparing.CONSTANT_KINDS)} FROM c GROUP BY pair_idx")
def constants_histogram(spark, d):
    out = comparing.constants_histogram(frame(spark, d, standin.CONSTANTS), "pair_idx")
    return out.select("pair_idx", *[F.col(k).alias(f"n_{k}") for k in comparing.CONSTANT_KINDS])


# --- structs: a brand is a struct, its parts the fields; on the right the small parts are a struct of their own, one brand has another name on the left
LEFT_STRUCT = "CASE WHEN name = 'Brand#1' THEN 'First' ELSE name END"
RIGHT_STRUCT = "CASE WHEN p_size <= 10 THEN name || '_small' ELSE name END"

CATEGORY_SQL = f"CASE type {' '.join(f'''WHEN '{t}' THEN '{c}' ''' for t, c in KNOWN_TYPES.items())} END"
STRUCTS = f"f AS (SELECT *, {CATEGORY_SQL} AS category FROM ({duck(standin.FIELDS)})), " + ", ".join(
    f"{side} AS (SELECT row_number() OVER (ORDER BY name) AS idx, name, CAST(count(*) AS DOUBLE) AS field_count, {', '.join(f'''CAST(count(*) FILTER (category = '{c}') AS DOUBLE) AS {c}_count''' for c in comparing.CATEGORIES)} FROM (SELECT * REPLACE ({name} AS name) FROM f) GROUP BY name)"
    for side, name in (("sl", LEFT_STRUCT), ("sr", RIGHT_STRUCT))
)


def struct_sides(spark, d):
    from pyspark.sql import Window

    fields = frame(spark, d, standin.FIELDS)
    make = lambda rows: comparing.struct_metrics(rows, ("name",)).withColumn("idx", F.row_number().over(Window.orderBy("name")).cast("long"))  # noqa: E731  a few brands
    return make(fields.withColumn("name", F.expr(LEFT_STRUCT))), make(fields.withColumn("name", F.expr(RIGHT_STRUCT)))


@query(f"WITH {STRUCTS} SELECT name, {', '.join(f'CAST({m} AS BIGINT) AS {m}' for m in STRUCT_METRICS)} FROM sl")
def struct_category_counts(spark, d):
    return struct_sides(spark, d)[0].select("name", *STRUCT_METRICS)


@query(f"WITH {STRUCTS}, {p95_sql(STRUCT_METRICS, ('sl', 'sr'))} SELECT a.name AS left_name, b.name AS right_name, round({total_sql(STRUCT_METRICS, comparing.STRUCT_WEIGHTS)}, 6) AS total FROM sl a JOIN sr b ON a.name = b.name")
def struct_deviation(spark, d):
    a, b = struct_sides(spark, d)
    return comparing.struct_deviation(matching.match_structs(a, b), a, b).select("left_name", "right_name", F.round("total", 6).alias("total"))


@query(f"WITH {STRUCTS} SELECT 'right' AS side, name FROM sr WHERE name NOT IN (SELECT name FROM sl) UNION ALL SELECT 'left', name FROM sl WHERE name NOT IN (SELECT name FROM sr)")
def struct_missing(spark, d):
    a, b = struct_sides(spark, d)
    pairs = matching.match_structs(a, b)
    one = lambda side, which: comparing.struct_missing(side, pairs, which).select(F.lit(which).alias("side"), "name")
    return one(b, "right").unionAll(one(a, "left"))


# --- call graphs

CALLS = f"WITH RECURSIVE c AS ({duck(standin.CALLS)}), v AS ({duck(standin.VERTICES)}), n AS (SELECT name, count(*) AS k FROM v GROUP BY name), rc AS (SELECT c.idx, callee, coalesce(k, 0) AS k FROM c LEFT JOIN n ON callee = name)"
calls_of = lambda spark, d: (frame(spark, d, standin.CALLS), frame(spark, d, standin.VERTICES))


@query(f"{CALLS} SELECT DISTINCT rc.idx AS src, v.idx AS dst FROM rc JOIN v ON callee = name")
def call_edges(spark, d):
    return callgraph.edges(*calls_of(spark, d))


@query(f"{CALLS} SELECT DISTINCT rc.idx AS src, v.idx AS dst FROM rc JOIN v ON callee = name WHERE k = 1")
def call_edges_strict(spark, d):
    return callgraph.edges(*calls_of(spark, d), strict=True)


@query(f"{CALLS} SELECT count(*) FILTER (k = 1) AS resolved, count(*) FILTER (k > 1) AS ambiguous, count(*) FILTER (k = 0) AS unresolved FROM rc")
def call_resolution_counts(spark, d):
    return callgraph.resolution_counts(*calls_of(spark, d))


@query(f"{CALLS} SELECT DISTINCT rc.idx FROM rc JOIN v ON callee = name AND v.idx = rc.idx")
def self_recursion(spark, d):
    return callgraph.self_recursive(callgraph.edges(*calls_of(spark, d)))


GRAPH = f"WITH RECURSIVE g AS ({duck(standin.GRAPH_LEFT)}), h AS ({duck(standin.GRAPH_RIGHT)})"
REACH = "reach(a, b) AS (SELECT src, dst FROM {0} UNION SELECT a, dst FROM reach JOIN {0} ON b = src)"
graph_of = lambda spark, d, sql=standin.GRAPH_LEFT: frame(spark, d, sql)
vertices_of = lambda spark, d: frame(spark, d, standin.VERTICES).withColumn("report_id", F.lit("r"))
SEEDS = (1, 3, 24, 100, 171)


@query(f"{GRAPH}, up(seed, idx) AS (SELECT dst, src FROM g WHERE dst IN {SEEDS} UNION SELECT seed, src FROM up JOIN g ON up.idx = dst) SELECT * FROM up")
def upstream_closure(spark, d):
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "idx long")
    return callgraph.callers(cut(graph_of(spark, d)), seeds, cut)


SCC_SQL = f"{GRAPH}, {REACH.format('g')}, m AS (SELECT x.a AS idx, least(x.a, min(x.b)) AS scc, count(DISTINCT x.b) AS n FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(f"{SCC_SQL} SELECT v.p_partkey AS idx, CASE WHEN n > 1 THEN 'mutual' WHEN n = 1 THEN 'self' ELSE 'none' END AS scc_kind, coalesce(n, 1) AS scc_size FROM part v LEFT JOIN m ON v.p_partkey = m.idx")
def scc_kind(spark, d):
    edges = graph_of(spark, d).withColumn("report_id", F.lit("r"))
    return callgraph.recursion(vertices_of(spark, d), edges).select("idx", "scc_kind", "scc_size")


@query(f"{SCC_SQL.replace(duck(standin.GRAPH_LEFT), duck(standin.RINGS))} SELECT v.p_partkey AS idx, coalesce(scc, v.p_partkey) AS scc FROM part v LEFT JOIN m ON v.p_partkey = m.idx")
def scc_distributed(spark, d):
    return callgraph.scc_distributed(vertices_of(spark, d), graph_of(spark, d, standin.RINGS), cut)


# Each vertex calls one other, so a search from the smallest open vertex walks one path and completes it from its end; `o` is the vertex where the walk starts.
ORDER_SQL = f"""{SCC_SQL}, vx AS ({duck(standin.VERTICES)}), own AS (SELECT idx, least(idx, coalesce(min(a), idx)) AS o FROM vx LEFT JOIN reach ON b = idx GROUP BY idx), held AS (SELECT o, count(*) AS size FROM own GROUP BY o),
 walk(o, idx, k) AS (SELECT o, o, 0 FROM held UNION ALL SELECT walk.o, dst, k + 1 FROM walk JOIN g ON src = walk.idx JOIN held ON held.o = walk.o WHERE k + 1 < size),
 placed AS (SELECT vx.*, o, coalesce(scc, vx.idx) AS scc, coalesce(n, 1) AS scc_size, CASE WHEN n > 1 THEN 'mutual' WHEN n = 1 THEN 'self' ELSE 'none' END AS scc_kind, min(k) OVER (PARTITION BY coalesce(scc, vx.idx)) AS root_k FROM vx JOIN walk USING (idx) LEFT JOIN m ON m.idx = vx.idx),
 groups AS (SELECT scc, row_number() OVER (ORDER BY min(o), min(root_k) DESC) AS scc_id FROM placed WHERE scc_kind <> 'none' GROUP BY scc)
 SELECT 'r' AS report_id, idx, row_number() OVER (ORDER BY o, root_k DESC, file, line_start, name, idx) - 1 AS pos, scc_id, scc_kind, scc_size FROM placed LEFT JOIN groups USING (scc)"""


@query(ORDER_SQL)
def order_bottom_up(spark, d):
    return callgraph.bottom_up(vertices_of(spark, d), graph_of(spark, d).withColumn("report_id", F.lit("r")))


@query(f"WITH RECURSIVE g AS ({duck(standin.FOREST)}), w(idx, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT src, level + 1 FROM w JOIN g ON dst = idx) SELECT idx, max(level) AS level FROM w GROUP BY idx")
def order_levels(spark, d):
    return callgraph.levels(cut(frame(spark, d, standin.FOREST)), vertices_of(spark, d), cut)


# Both sides' graphs are over parts; a pair joins the two sides' parts of one name, one part in four has none.
GRAPH_PAIRS = f"p AS (SELECT a.idx AS x FROM ({duck(standin.OWN_NAMES)}) a JOIN ({duck(standin.BASE_NAMES)}) b USING (name)), a AS (SELECT DISTINCT src, dst FROM g WHERE src IN (SELECT x FROM p) AND dst IN (SELECT x FROM p)), b AS (SELECT DISTINCT src, dst FROM h WHERE src IN (SELECT x FROM p) AND dst IN (SELECT x FROM p))"


def graph_sides(spark, d):
    own = cut(matching.match_exact(frame(spark, d, standin.OWN_NAMES), frame(spark, d, standin.BASE_NAMES)).select(F.col("left_idx").alias("pair_idx"), "left_idx", "right_idx"))
    return own, callgraph.translated(graph_of(spark, d), own, "left"), callgraph.translated(graph_of(spark, d, standin.GRAPH_RIGHT), own, "right")


@query(f"{GRAPH}, {GRAPH_PAIRS} SELECT 'left' AS side, src AS src_pair, dst AS dst_pair FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', src, dst FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def edge_diff(spark, d):
    _, a, b = graph_sides(spark, d)
    x, y = callgraph.edge_diff(a, b)
    return x.select(F.lit("left").alias("side"), "src_pair", "dst_pair").unionAll(y.select(F.lit("right").alias("side"), "src_pair", "dst_pair"))


def scc_sides(spark, d):
    make = lambda sql: cut(callgraph.recursion(vertices_of(spark, d), graph_of(spark, d, sql).withColumn("report_id", F.lit("r"))).select("idx", "scc_kind", "scc_size"))  # noqa: E731  one after the other: each is a task's work
    return make(standin.GRAPH_LEFT), make(standin.GRAPH_RIGHT)


KINDS = f"{GRAPH}, {GRAPH_PAIRS}" + "".join(f", {REACH.format(t).replace('reach', f'reach_{t}')}, k_{t} AS (SELECT p_partkey AS idx, coalesce(n, 1) AS n, CASE WHEN n > 1 THEN 'mutual' WHEN n = 1 THEN 'self' ELSE 'none' END AS kind FROM part LEFT JOIN (SELECT x.a, count(DISTINCT x.b) AS n FROM reach_{t} x JOIN reach_{t} y ON x.a = y.b AND x.b = y.a GROUP BY x.a) ON a = p_partkey)" for t in ("g", "h"))
CHANGED = " UNION ALL ".join(f"SELECT {end} AS x FROM (SELECT * FROM {one} EXCEPT SELECT * FROM {two})" for one, two in (("a", "b"), ("b", "a")) for end in ("src", "dst"))


@query(f"{KINDS}, ch AS (SELECT x, count(*) AS k FROM ({CHANGED}) GROUP BY x) SELECT p.x AS pair_idx, coalesce(ch.k, 0) + CASE WHEN k_g.kind <> k_h.kind THEN 2.0 ELSE 0.0 END + 0.5::DOUBLE * abs(k_g.n - k_h.n) AS total, k_g.kind AS left_recursive_kind, k_h.kind AS right_recursive_kind FROM p JOIN k_g ON k_g.idx = p.x JOIN k_h ON k_h.idx = p.x LEFT JOIN ch ON ch.x = p.x")
def graph_pair_diff(spark, d):
    own, a, b = graph_sides(spark, d)
    return callgraph.graph_diff(own, a, b, *scc_sides(spark, d)).select("pair_idx", "total", "left_recursive_kind", "right_recursive_kind")


@query(f"{KINDS} SELECT (SELECT count(*) FROM p) AS matched_pairs, (SELECT count(*) FROM p JOIN k_g ON k_g.idx = x JOIN k_h ON k_h.idx = x WHERE k_g.kind <> k_h.kind) AS recursive_kind_mismatches, (SELECT count(*) FROM p JOIN k_g ON k_g.idx = x JOIN k_h ON k_h.idx = x WHERE k_g.n <> k_h.n) AS scc_size_mismatches, (SELECT count(*) FROM a) AS translated_edges_in_left, (SELECT count(*) FROM b) AS translated_edges_in_right, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS edges_only_in_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS edges_only_in_right")
def graph_diff_summary(spark, d):
    own, a, b = graph_sides(spark, d)
    return callgraph.diff_summary(callgraph.graph_diff(own, a, b, *scc_sides(spark, d)), a, b)


UP = "up_{0}(idx) AS (SELECT src FROM {0} WHERE dst IN {1} UNION SELECT src FROM up_{0} JOIN {0} ON up_{0}.idx = dst)"
UPSTREAM = f"{GRAPH}, {GRAPH_PAIRS}, {UP.format('g', SEEDS)}, {UP.format('h', SEEDS)}"


def upstream_sides(spark, d):
    own, _, _ = graph_sides(spark, d)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "idx long")
    up = [callgraph.callers(cut(graph_of(spark, d, sql)), seeds, cut).select("idx").distinct() for sql in (standin.GRAPH_LEFT, standin.GRAPH_RIGHT)]
    return own, up


@query(f"{UPSTREAM} SELECT x AS pair_idx, x IN (SELECT idx FROM up_g) AS left_in_upstream, x IN (SELECT idx FROM up_h) AS right_in_upstream, x IN (SELECT idx FROM up_g) AND x IN (SELECT idx FROM up_h) AS overlap FROM p WHERE x IN (SELECT idx FROM up_g) OR x IN (SELECT idx FROM up_h)")
def upstream_pairs(spark, d):
    own, (a, b) = upstream_sides(spark, d)
    rows = callgraph.upstream_pairs(own, own.withColumn("total", F.lit(0.0)), a, b)
    return rows.select("pair_idx", "left_in_upstream", "right_in_upstream", "overlap")


@query(f"""{UPSTREAM}, w AS (SELECT 'left' AS side, idx, idx AS counterpart, '{callgraph.NOT_RIGHT}' AS message FROM up_g WHERE idx IN (SELECT x FROM p) AND idx NOT IN (SELECT idx FROM up_h)
 UNION ALL SELECT 'right', idx, idx, '{callgraph.NOT_LEFT}' FROM up_h WHERE idx IN (SELECT x FROM p) AND idx NOT IN (SELECT idx FROM up_g)
 UNION ALL SELECT 'left', idx, NULL, '{callgraph.NO_COUNTERPART}' FROM up_g WHERE idx NOT IN (SELECT x FROM p) UNION ALL SELECT 'right', idx, NULL, '{callgraph.NO_COUNTERPART}' FROM up_h WHERE idx NOT IN (SELECT x FROM p)) SELECT * FROM w""")
def upstream_warnings(spark, d):
    own, (a, b) = upstream_sides(spark, d)
    rows = callgraph.upstream_pairs(own, own.withColumn("total", F.lit(0.0)), a, b)
    return callgraph.upstream_warnings(rows, own, a, b)


# --- order files


@query(f"{WITH}, o AS ({duck(standin.PROGRESS)}), z AS (SELECT name, file, arg_max(translated, row_no) AS t FROM o GROUP BY ALL) SELECT idx, r.name, coalesce(z.t, 'FALSE') AS translated FROM r LEFT JOIN z USING (name, file)")
def order_merge(spark, d):
    from ..sources import tables

    return tables.merge_progress(R(spark, d), frame(spark, d, standin.PROGRESS)).select("idx", "name", "translated")


@query(f"{WITH}, {PAIRS}, z AS (SELECT b.name, b.file, b.line_start, arg_max(a.name, pair_idx) AS left_name, arg_max(strategy, pair_idx) AS match_strategy FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx GROUP BY ALL) SELECT r.idx, r.name, coalesce(z.left_name, '') AS left_name, coalesce(z.match_strategy, '') AS match_strategy FROM r LEFT JOIN z ON r.name = z.name AND r.file = z.file AND r.line_start = z.line_start")
def order_annotate(spark, d):
    from ..sources import tables

    pairs, a, b = paired_sides(spark, d, comparing.IDENTITY, comparing.IDENTITY)
    rows = tables.annotate(b.select("idx", "name", "file", F.col("line_start").cast("string").alias("line_start")), pairs, a, b)
    return rows.select("idx", "name", "left_name", "match_strategy")


# --- prediction

TRAIN = f"{WITH}, {PAIRS}, e AS (SELECT b.loc_code AS x, a.cyclomatic AS y FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx), s AS (SELECT count(*) + 1e-6 AS n, sum(x) AS sx, sum(x * x) + 1e-6 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM e), fit AS (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM s)"


def one_feature(spark, d):
    """The pairs with both metrics, the fit over them, the right side."""
    pairs, a, b = paired_sides(spark, d, ("cyclomatic",), ("loc_code",))
    rows = cut(matching.paired(pairs, a.select("idx", "cyclomatic"), b.select("idx", "loc_code")))
    learnt = prediction.train(rows.select(F.col("r_loc_code").alias("x_loc_code"), F.col("l_cyclomatic").alias("y_cyclomatic")), ("loc_code",), ("cyclomatic",))
    return rows, learnt["targets"]["cyclomatic"], b


@query(f"{TRAIN} SELECT idx, round(b0 + b1 * loc_code, 4) AS predicted FROM r, fit")
def ols_predict(spark, d):
    _, fit, b = one_feature(spark, d)
    return b.select("idx", F.round(prediction.linear(fit, F.col), 4).alias("predicted"))


@query(f"{TRAIN}, sd AS (SELECT greatest(stddev_pop(y - (b0 + b1 * x)), 1e-6) AS sd FROM e, fit) SELECT pair_idx, round((a.cyclomatic - (b0 + b1 * b.loc_code)) / sd, 4) AS z FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx, fit, sd")
def prediction_z(spark, d):
    rows, fit, _ = one_feature(spark, d)
    z = prediction.outlier(F.col("l_cyclomatic"), prediction.linear(fit, lambda f: F.col(f"r_{f}")), fit["residual_std"])
    return rows.select("pair_idx", F.round(z, 4).alias("z"))


@query(f"{WITH} SELECT idx, early_returns + CASE WHEN goto_count >= 1 THEN 1 ELSE 0 END AS early_returns, branches - CASE WHEN goto_count >= 1 THEN 1 ELSE 0 END AS branches, cyclomatic - CASE WHEN goto_count >= 1 THEN 1 ELSE 0 END - CASE WHEN branches >= 5 THEN 1 ELSE 0 END AS cyclomatic FROM r")
def heuristics(spark, d):
    rows = R(spark, d).withColumn("input_types", F.array(F.lit("int")))
    out = prediction.adjusted({m: F.col(m) for m in ("early_returns", "branches", "cyclomatic")}, prediction.RULES)
    return rows.select("idx", *[c.alias(m) for m, c in out.items()])


@query()
def predict_full(spark, d):
    extra = {"constants": F.col("loops"), "input_types": F.array(F.lit("int"))}
    asked = (*METRICS, "arity", "outputs_count", "loc_asm")
    pairs, a, b = paired_sides(spark, d, asked, asked)
    a, b = a.withColumns(extra), b.withColumns(extra)
    model = prediction.train(cut(prediction.examples(pairs, a, b)))
    out = prediction.report(b, model, pairs, a)
    return out.select("idx", "name", "matched_name", *[F.round(f"p_{t}", 3).alias(f"p_{t}") for t in prediction.TARGETS], *[F.round(f"z_{t}", 3).alias(f"z_{t}") for t in prediction.TARGETS])


# --- rules and rankings one by one

WANT_CLASS, WANT_LINE = "CASE idx % 4 WHEN 1 THEN '' WHEN 2 THEN 'Brand#1' WHEN 3 THEN 'Brand#' || (idx % 25 + 1) END", "CASE WHEN idx % 3 > 0 THEN CAST(idx % 40 + 1 AS INT) END"


@query(f"{WITH}, w AS (SELECT *, {WANT_CLASS} AS wc, {WANT_LINE} AS wl FROM l) SELECT idx, CASE WHEN wc IS NULL THEN true WHEN wc = '' THEN enclosing_type IS NULL ELSE coalesce(enclosing_type = wc, false) END AS class_fits, wl IS NULL OR line_start = wl AS line_fits FROM w")
def class_and_line(spark, d):
    rows = L(spark, d)
    return rows.select("idx", scalar.class_matches(F.col("enclosing_type"), F.expr(WANT_CLASS)).alias("class_fits"), scalar.line_matches(F.col("line_start"), F.expr(WANT_LINE)).alias("line_fits"))


@query(f"WITH t AS ({duck(standin.FLOATS)}) SELECT id, CASE WHEN NOT regexp_matches(text, '^[+-]?0[xX]') THEN TRY_CAST(regexp_replace(text, '[fFLldD]+$', '') AS DOUBLE) END AS value FROM t")
def parse_float(spark, d):
    return frame(spark, d, standin.FLOATS).select("id", scalar.parse_float(F.col("text")).alias("value"))


@query(f"WITH t AS ({duck(standin.RADIX)}) SELECT id, text, CAST(value AS BIGINT) AS value FROM t")
def parse_int_radix(spark, d):
    return frame(spark, d, standin.RADIX).select("id", "text", scalar.parse_int(F.col("text")).alias("value"))


DISPLAY_KINDS = "CASE event_id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'string' WHEN 4 THEN 'char' ELSE 'bool' END"


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '0x' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN event_id || '.0f' WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN chr(39) || event_type || chr(39) ELSE CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END END AS display FROM events""")
def constant_display(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    text = F.expr("CASE event_id % 6 WHEN 0 THEN '0x' || event_id WHEN 2 THEN event_id || '.0f' END")
    c = F.struct(F.expr(DISPLAY_KINDS).alias("kind"), text.alias("text"), F.col("event_id").alias("int_value"), F.lit(None).cast("double").alias("float_value"), F.col("event_type").alias("str_value"), (F.col("event_id") % 4 == 1).alias("bool_value"))
    return rows.select("event_id", scalar.constant_display(c).alias("display"))


@query(f"{WITH} SELECT idx, concat_ws('::', enclosing_type, name) AS qualified, array_to_string(string_split(file, '/')[-2:], '/') AS tail FROM l")
def qualified_name(spark, d):
    return L(spark, d).select("idx", scalar.qualified_name(F.col("enclosing_type"), F.col("name")).alias("qualified"), scalar.file_tail(F.col("file")).alias("tail"))


@query(f"{WITH}, x AS (SELECT file, CASE lower(regexp_extract(file, '\\.([^./]+)$', 1)) WHEN 'c' THEN 'C' WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python' WHEN 'r' THEN 'R' WHEN 'pl' THEN 'Perl' WHEN 'f90' THEN 'Fortran' ELSE 'Cpp' END AS language, count(*) AS n FROM r GROUP BY ALL) SELECT file, file || ': ' || language || ' ' || n || ' functions' AS line FROM x")
def summary_lines(spark, d):
    counted = R(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("file", scalar.summary_line(F.col("file"), scalar.language_of(F.col("file")), F.col("n")).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS shown FROM documents")
def truncate_texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalar.truncate(F.col("text"), 60).alias("shown"))


# Sides by number; the left ones are small, the right ones constructors, destructors and plain methods.
EXEMPT_NAME = "CASE idx % 3 WHEN 0 THEN 'Box::Box' WHEN 1 THEN 'Box::~Box' ELSE 'Box::size' END"


@query(f"""{WITH}, z AS (SELECT r.idx, {EXEMPT_NAME.replace('idx', 'r.idx')} AS right_name, r.idx % 4 AS x, r.loc_code AS y, r.idx % 2 = 0 AS mapped FROM r)
 SELECT idx AS pair_idx, right_name, 'left LOC ' || x || ' is ' || CAST(round_even(100 * (greatest(x, 1) / greatest(y, 1)), 0) AS BIGINT) || '% of right LOC ' || CAST(y AS BIGINT) AS reason FROM z WHERE NOT (mapped AND x <= 1 AND right_name <> 'Box::size') AND greatest(x, 1) / greatest(y, 1) < 0.2""")
def partial_exempt(spark, d):
    right = R(spark, d).withColumn("name", F.expr(EXEMPT_NAME))
    left = right.withColumn("loc_code", (F.col("idx") % 4).cast("double"))
    pairs = right.select(F.col("idx").alias("pair_idx"), F.col("idx").alias("left_idx"), F.col("idx").alias("right_idx"), F.when(F.col("idx") % 2 == 0, "Mapping").otherwise("ExactName").alias("strategy"))
    return comparing.partial(pairs, left, right).select("pair_idx", "right_name", "reason")


SINGLE_KEYS = ("cognitive", "cyclomatic", "nesting", "loc", "halstead", "nesting-x-loc")


@query(f"{WITH} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS key, idx, CAST({comparing.SORT_KEYS.get(k, 'max_combined_nesting * loc_code')} AS DOUBLE) AS score FROM r ORDER BY score DESC, idx LIMIT 20)" for k in SINGLE_KEYS))
def sort_keys(spark, d):
    from functools import reduce

    rows = [comparing.sort_report(R(spark, d), k).select(F.lit(k).alias("key"), "idx", "score") for k in SINGLE_KEYS]
    return reduce(lambda a, b: a.unionAll(b), rows)


CONTRIBUTIONS = " UNION ALL ".join(f"SELECT pair_idx, {i} AS nth, '{m}' AS metric, {comparing.WEIGHTS.get(m, 1.0)}::DOUBLE * (abs(a.{m} - b.{m}) / (SELECT scale FROM scale WHERE metric = '{m}')) AS share FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx" for i, m in enumerate(METRICS))


@query(f"{WITH}, {PAIRS}, {p95_sql()}, c AS ({CONTRIBUTIONS}), o AS (SELECT *, row_number() OVER (PARTITION BY pair_idx ORDER BY share DESC, nth) AS n FROM c) SELECT pair_idx, coalesce(string_agg(metric, ', ' ORDER BY n) FILTER (n <= 3 AND share > 0), '') AS first, round(max(share), 6) AS largest FROM o GROUP BY pair_idx")
def compare_contributors(spark, d):
    rows = comparing.deviation(*paired_sides(spark, d))
    above = F.filter(F.slice("per_metric", 1, 3), lambda x: x["contribution"] > 0)
    return rows.select("pair_idx", F.array_join(F.transform(above, lambda x: x["metric"]), ", ").alias("first"), F.round(F.col("per_metric")[0]["contribution"], 6).alias("largest"))


@query(f"{WITH}, {PAIRS} SELECT pair_idx, {' + '.join(f'abs(a.{m} - b.{m})' for m in METRICS)} AS total FROM pairs JOIN l a ON a.idx = left_idx JOIN r b ON b.idx = right_idx")
def fallback_deviation(spark, d):
    return comparing.fallback_deviation(*paired_sides(spark, d)).select("pair_idx", "total")


@query(ORACLE["constants_diff"].replace("FROM s GROUP BY pair_idx", "FROM s GROUP BY pair_idx HAVING sum(a + b) > 0 ORDER BY score DESC, pair_idx LIMIT 20"))
def constants_top(spark, d):
    out = comparing.ranked_by(comparing.differing(comparing.constants_diff(frame(spark, d, standin.CONSTANTS))), "score")
    size = lambda c: F.size(c).cast("long").alias(c)
    return out.select("pair_idx", size("only_left"), size("only_right"), size("in_both"), F.col("score").cast("double").alias("score"))


@query(f"WITH c AS ({duck(standin.CONSTANTS)}) SELECT pair_idx, kind, string_agg(value, ',' ORDER BY value) AS members, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY pair_idx, kind")
def constants_by_kind(spark, d):
    out = comparing.constants_by_kind(frame(spark, d, standin.CONSTANTS), "pair_idx")
    return out.select("pair_idx", "kind", F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("n"))


@query(f"WITH c AS ({duck(standin.CONSTANTS)}) SELECT pair_idx, value, count(*) AS n FROM c GROUP BY ALL")
def constant_counts(spark, d):
    return comparing.multiplicity(frame(spark, d, standin.CONSTANTS), "pair_idx", "value")


@query(ORACLE["struct_deviation"].replace("SELECT a.name", "SELECT * FROM (SELECT a.name") + ") ORDER BY total DESC, left_name LIMIT 20")
def struct_top(spark, d):
    a, b = struct_sides(spark, d)
    rows = comparing.struct_deviation(matching.match_structs(a, b), a, b).withColumn("total", F.round("total", 6))
    return comparing.ranked_by(rows, "total", "left_name").select("left_name", "right_name", "total")


# --- texts and JSON


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x : x <> '') AS words, string_split(text, chr(10)) AS lines FROM documents)
 SELECT doc_id, CAST(len(lines) AS INT) AS n_lines, CAST(len(list_filter(lines, lambda x : trim(x) = '')) AS INT) AS n_blank, CAST(len(words) AS INT) AS n_tokens, CAST(len(list_distinct(words)) AS INT) AS n_distinct FROM w""")
def text_loc(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    words, lines = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != ""), F.split("text", "\n")
    return rows.select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).alias("n_blank"), F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x : x <> '') AS words FROM documents),
 k AS (SELECT doc_id, list_filter(words, lambda x : length(x) <= 3) AS ops, list_filter(words, lambda x : length(x) > 3) AS names FROM w),
 n AS (SELECT doc_id, len(list_distinct(ops)) AS n1, len(list_distinct(names)) AS n2, len(ops) AS b1, len(names) AS b2 FROM k)
 SELECT doc_id, round(CASE WHEN n1 + n2 > 0 THEN (b1 + b2) * log2(n1 + n2) ELSE 0 END, 6) AS volume, round(CASE WHEN n2 > 0 THEN (n1 / 2.0::DOUBLE) * (b2 / n2::DOUBLE) ELSE 0 END, 6) AS difficulty FROM n""")
def halstead(spark, d):
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.filter(words, lambda x: F.length(x) <= 3).alias("ops"), F.filter(words, lambda x: F.length(x) > 3).alias("names"))
    n1, n2, b1, b2 = F.size(F.array_distinct("ops")), F.size(F.array_distinct("names")), F.size("ops"), F.size("names")
    return rows.select("doc_id", F.round(scalar.halstead_volume(n1, n2, b1, b2), 6).alias("volume"), F.round(scalar.halstead_difficulty(n1, n2, b2), 6).alias("difficulty"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_scan(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
