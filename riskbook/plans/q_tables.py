"""Queries of sources, sinks, profiles and column mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import norm_name
from riskbook.operators.staging import new_path, staged
from riskbook.plans.fixtures import table
from riskbook.sources import tables as T

QUERIES: dict = {}
SQL: dict = {}
NAMES = ("customer", "events", "lineitem", "nation", "orders", "part", "supplier")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark) -> str:
    """A new folder for what a query writes."""
    return new_path(spark)


def columns_of(spark, d):
    """The catalog of the given tables' columns, from all their rows."""
    return staged(T.column_catalog({n: table(spark, d, n) for n in NAMES}))


_WORDS = ", ".join(f"'{w}'" for w in C.BINARY_WORDS)
_HINTS = ", ".join(f"({i}, '{f}', '{''.join(x for x in w.lower() if x.isalnum())}')" for i, (f, words) in enumerate(C.HINTS.items()) for w in words)
_FIELDS = ", ".join(f"('{f}', '{role}')" for f, role in C.FIELDS.items())
_CATALOG = "WITH RECURSIVE distinct_values AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, name, vals FROM (UNPIVOT (SELECT list(DISTINCT CAST(COLUMNS(*) AS VARCHAR)) FROM {n}) ON COLUMNS(*) INTO NAME name VALUE vals)" for n in NAMES) + f"""),
places AS (SELECT table_name, column_name AS name, CAST(column_index AS INT) - 1 AS position FROM duckdb_columns() WHERE table_name IN ({", ".join(f"'{n}'" for n in NAMES)})),
cat AS (SELECT table_name, name, position, len(vals) BETWEEN 1 AND 2 OR len(vals) <= 6 AND list_has_any([lower(trim(v)) FOR v IN vals], [{_WORDS}]) AS is_binary FROM distinct_values JOIN places USING (table_name, name)),
hints(field_no, field, kw) AS (VALUES {_HINTS}), fields(field, role) AS (VALUES {_FIELDS}),
named AS (SELECT *, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS n FROM cat),
scores AS (SELECT table_name, field_no, field, name, position, is_binary, max(CASE WHEN n = kw THEN 1.0 WHEN length(kw) >= 3 AND (starts_with(n, kw) OR ends_with(n, kw)) THEN 0.85 WHEN length(kw) >= 3 AND contains(n, kw) THEN 0.7 ELSE 0 END)::DOUBLE AS score FROM named, hints GROUP BY ALL),
best AS (SELECT table_name, field_no, any_value(field) AS field, list({{'name': name, 'score': score}} ORDER BY score DESC, position) AS choices FROM scores WHERE score >= 0.7 AND field <> 'target' GROUP BY ALL),
walk AS (SELECT DISTINCT table_name, -1 AS at, []::VARCHAR[] AS used, NULL::VARCHAR AS field, NULL::VARCHAR AS name, NULL::DOUBLE AS confidence FROM cat
  UNION ALL SELECT w.table_name, w.at + 1, CASE WHEN len(free) > 0 THEN list_append(w.used, free[1].name) ELSE w.used END, b.field, free[1].name, free[1].score
  FROM (SELECT w.*, b.field AS f, list_filter(coalesce(b.choices, []), lambda c: NOT list_contains(w.used, c.name)) AS free FROM walk w LEFT JOIN best b ON b.table_name = w.table_name AND b.field_no = w.at + 1 WHERE w.at < {len(C.HINTS) - 1}) w LEFT JOIN (SELECT DISTINCT field_no, field FROM hints) b ON b.field_no = w.at + 1),
mapped AS (SELECT table_name, field, name, round(confidence, 2) AS confidence FROM walk WHERE name IS NOT NULL)
"""


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scan_table(spark, d):
    path = scratch(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias(" o_orderkey"), "o_totalprice", F.col("o_orderpriority").alias("o_orderpriority ")).write.csv(path, header=True)
    return T.read_table(spark, path).select(F.col("o_orderkey").cast("bigint"), "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def row_cap(spark, d):
    return T.row_cap(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0")
def scan_delimited(spark, d):
    path = scratch(spark)
    label = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))  # rows without one go
    table(spark, d, "customer").withColumn("c_mktsegment", label).withColumn("Unnamed: 0", F.lit(1)).write.csv(path, header=True, sep=";")
    return T.read_table(spark, path, sep=";", columns=["c_custkey", "c_mktsegment"], label="c_mktsegment").select(F.col("c_custkey").cast("bigint"), "c_mktsegment")


@query("SELECT o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scan_filtered(spark, d):
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T.scan_filtered(table(spark, d, "orders"), keep, "o_custkey", ["o_totalprice", "o_orderstatus"])


@query("SELECT o_orderkey, o_custkey AS l_partkey, x.l_partkey AS l_partkey_1, x.l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_quantity)) AS l_partkey, min_by(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1) x ON o_orderkey = l_orderkey")
def scan_glob(spark, d):
    """The first line of each order by line number, from all files of a pattern; a column of the base has the same name."""
    parts = spark.read.parquet(f"{d}/lineite*.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("l_partkey"))
    return T.scan_glob(base, [parts], "o_orderkey", [["l_linenumber", "l_partkey", "l_quantity"]]).select("o_orderkey", "l_partkey", "l_partkey_1", "l_quantity")


@query("SELECT event_id, user_id, value FROM events")
def sink_table(spark, d):
    return T.write_table(table(spark, d, "events").select("event_id", "user_id", "value"), scratch(spark))


_PROFILE = """WITH x AS (SELECT 'o_custkey' AS name, 'bigint' AS dtype, o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'o_orderstatus', 'string', o_orderkey, o_orderstatus FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', o_orderkey, o_orderpriority FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) AS r FROM x WHERE value IS NOT NULL),
s AS (SELECT name, list(value ORDER BY key) AS sample FROM f WHERE r <= 5 GROUP BY 1),
p AS (SELECT name, any_value(dtype) AS dtype, round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 1) AS null_pct, count(DISTINCT value) AS n_unique, count(*) AS n, avg(CAST(TRY_CAST(value AS DOUBLE) IS NOT NULL AS INT)) AS castable FROM x GROUP BY 1)
"""


def order_profile(spark, d):
    return T.profile_columns(table(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query(_PROFILE + "SELECT name, dtype, array_to_string(sample, '|') AS sample, null_pct, n_unique FROM p JOIN s USING (name)")
def profile_columns(spark, d):
    return order_profile(spark, d).select("name", "dtype", F.concat_ws("|", "sample").alias("sample"), "null_pct", "n_unique")


@query(_PROFILE + "SELECT name, CASE WHEN dtype = 'bigint' THEN 'integer' WHEN n_unique <= greatest(20, floor(0.05 * n)) THEN 'categorical' WHEN castable > 0.8 THEN 'numeric_text' ELSE 'text' END AS kind FROM p")
def friendly_dtype(spark, d):
    return T.friendly_dtype(order_profile(spark, d)).select("name", "kind")


@query(_PROFILE + "SELECT 'orders' AS filename, max(n) AS n_rows, string_agg(name || ' ' || dtype || ' ' || n_unique || ' ' || array_to_string(sample, ','), '|' ORDER BY name) AS columns FROM p JOIN s USING (name)")
def profile_file(spark, d):
    return T.profile_file(order_profile(spark, d), "orders").select("filename", "n_rows", F.concat_ws("|", F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["dtype"], c["n_unique"].cast("string"), F.concat_ws(",", c["sample"])))).alias("columns"))


@query("SELECT item_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS sample FROM benchmark")
def sample_cell(spark, d):
    from riskbook.functions import sample_cell as cut

    return table(spark, d, "benchmark").select("item_id", cut(F.col("text")).alias("sample"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS name FROM part")
def norm_names(spark, d):
    return table(spark, d, "part").select("p_partkey", norm_name(F.col("p_name")).alias("name"))



@query(_CATALOG + "SELECT table_name, field, name, score FROM scores WHERE score > 0")
def hint_scores(spark, d):
    return T.hint_scores(columns_of(spark, d)).where("score > 0").select("table_name", "field", "name", "score")


@query(_CATALOG + "SELECT * FROM mapped")
def heuristic_map(spark, d):
    return T.heuristic_map(columns_of(spark, d))


@query(_CATALOG + """, t AS (SELECT s.*, s.is_binary AND m.name IS NULL AS able FROM scores s LEFT JOIN mapped m ON s.table_name = m.table_name AND s.name = m.name WHERE s.field = 'target'),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY able DESC, score DESC, CASE WHEN able THEN position ELSE -position END DESC) AS k FROM t)
SELECT table_name, name, round(greatest(0.6, score), 2) AS confidence FROM r WHERE k = 1 AND (able OR score >= 0.7)""")
def pick_target(spark, d):
    columns = columns_of(spark, d)
    return T.pick_target(columns, T.heuristic_map(columns))


@query(_CATALOG + "SELECT table_name, field, name FROM mapped JOIN fields USING (field) WHERE role = 'protected'")
def detect_protected(spark, d):
    return T.detect_protected(T.heuristic_map(columns_of(spark, d)))


_GIVEN = _CATALOG + """, o AS (SELECT table_name, 'loan_id' AS field, CASE WHEN table_name = 'part' THEN NULL WHEN table_name = 'nation' THEN 'no_such' ELSE name END AS given, 0.99::DOUBLE AS c FROM cat WHERE position = 0)"""


@query(_GIVEN + """ SELECT table_name, field, CASE WHEN o.field IS NOT NULL AND (o.given IS NULL OR o.given IN (SELECT name FROM cat x WHERE x.table_name = o.table_name)) THEN o.given ELSE m.name END AS name, coalesce(o.c, m.confidence) AS confidence FROM mapped m FULL JOIN o USING (table_name, field)""")
def merge_mapping(spark, d):
    """A user's edits: the first column is the id, but for one table without and one with a column that it doesn't have."""
    columns = columns_of(spark, d)
    given = F.when(F.col("table_name") == "part", None).when(F.col("table_name") == "nation", "no_such").otherwise(F.col("name"))
    override = columns.where("position = 0").select("table_name", F.lit("loan_id").alias("field"), given.alias("override_name"), F.lit(0.99).alias("confidence"))
    return T.merge_mapping(T.heuristic_map(columns), override, columns)


@query(_CATALOG + "SELECT t.table_name, f.field, m.name FROM (SELECT DISTINCT table_name FROM cat) t CROSS JOIN fields f LEFT JOIN mapped m ON m.table_name = t.table_name AND m.field = f.field")
def sanitise_mapping(spark, d):
    columns = columns_of(spark, d)
    junk = columns.where("position = 0").select("table_name", F.lit("dscr").alias("field"), F.lit("no_such").alias("name"))
    return T.sanitise_mapping(T.heuristic_map(columns).select("table_name", "field", "name").unionByName(junk), columns)


@query(_CATALOG + "SELECT table_name, name, is_binary AS looks_binary FROM cat")
def looks_binary(spark, d):
    return columns_of(spark, d).select("table_name", "name", F.col("is_binary").alias("looks_binary"))


@query("SELECT o_orderkey AS loan_id, o_totalprice AS loan_amount, o_orderpriority AS community FROM orders")
def project_canonical(spark, d):
    return T.project_canonical(table(spark, d, "orders"), {"loan_id": "o_orderkey", "loan_amount": "o_totalprice", "community": "o_orderpriority", "gender": None})
