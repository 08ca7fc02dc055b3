"""Registered queries of the number, scalar and matrix operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.model import Matrix, Numbers, array, grid, literal_array, numbered
from fluxgrid.operators import arithmetic as A
from fluxgrid.operators import lookups as L
from fluxgrid.operators import matrices as M
from fluxgrid.operators import shapes as P
from fluxgrid.operators import statistics as T
from fluxgrid.plans import chains, formulas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "filter_stats"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sf_dir: str) -> Numbers:
    """events as an array: value, user_id."""
    return array(table(spark, sf_dir, "events"), "event_id", ["value", "user_id"])


def parts(spark: SparkSession, sf_dir: str) -> Numbers:
    """part as an array: retail price, size."""
    return array(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice", "p_size"])


def shown(x: Numbers, digits: int = 6) -> DataFrame:
    """``_i`` and rounded doubles."""
    return x.df.select("_i", *[F.round(F.col(c).cast("double"), digits).alias(c) for c in x.columns])


@query(
    "filter_stats",
    """SELECT 0 AS "column", count(*) AS n, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 6) AS mean
       FROM lineitem WHERE l_quantity BETWEEN 10 AND 20
       UNION ALL SELECT 1, count(*), round(sum(l_extendedprice), 4), round(avg(l_extendedprice), 6)
       FROM lineitem WHERE l_quantity BETWEEN 10 AND 20""",
)
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name, rows by range, statistics by column."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), "l_quantity", "l_extendedprice")
    x, _ = P.columns_by_name(array(rows, "k", ["l_quantity", "l_extendedprice"]), ["quantity", "price"], "quantity, price")
    found = T.column_statistics(P.keep_in_range(x, 10, 20))
    return found.select("column", "n", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))


EV = "SELECT event_id AS _i, "


def elementwise(name: str, f: Callable[[Numbers], Numbers], first: str, second: str | None = None) -> None:
    """Register an elementwise operator of events with one SQL expression for each column."""
    cols = f"round(({first})::DOUBLE, 6) AS value" + (f", round(({second})::DOUBLE, 6) AS user_id" if second else "")
    QUERIES[name] = lambda spark, sf_dir: shown(f(values(spark, sf_dir)))
    ORACLES[name] = f"{EV}{cols} FROM events"


elementwise("abs", A.absolute, "abs(value)::FLOAT", "abs(user_id)::FLOAT")
elementwise("negate", A.negated, "(-value)::FLOAT", "(-user_id)::FLOAT")
elementwise("replace_nan", A.replace_nan, "value::FLOAT", "user_id::FLOAT")
elementwise("linear", lambda x: A.linear(x, x, 2.0, -0.5, 3.0), "1.5 * value + 3", "1.5 * user_id + 3")
elementwise("linear_abs", lambda x: A.linear(x, None, -2.0, summand=1.0, absolute_value=True), "abs(1 - 2 * value)", "abs(1 - 2 * user_id)")
elementwise("exponent", lambda x: A.exponent(A.linear(x.slice(0, 1), a=0.01)), "exp(0.01 * value)")
elementwise("exponent_10", lambda x: A.exponent(A.linear(x.slice(0, 1), a=0.001), "BASE_10"), "pow(10.0, 0.001 * value)")
elementwise("logarithm", lambda x: A.logarithm(x.slice(0, 1)), "ln(value)")
elementwise("logarithm_custom", lambda x: A.logarithm(x.slice(0, 1), "CUSTOM", 2.0), "ln(value) / ln(2.0)")
elementwise(
    "in_range", lambda x: A.in_range(x, 10, 100, 5.0, 2.0),
    "CASE WHEN value::FLOAT BETWEEN 10 AND 100 THEN 5 ELSE 2 END", "CASE WHEN user_id BETWEEN 10 AND 100 THEN 5 ELSE 2 END",
)
elementwise(
    "in_range_index", lambda x: A.in_range(x, None, 50, 1.0, 0.0, add_true_to_index=True, kind="double"),
    "CASE WHEN value::FLOAT <= 50 THEN 1 + event_id * 2 ELSE 0 END", "CASE WHEN user_id <= 50 THEN 2 + event_id * 2 ELSE 0 END",
)
elementwise(
    "several_ranges", lambda x: A.in_several_ranges(x, [10, 50, 100], [0, 1, 2, 3]),
    "CASE WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END",
    "CASE WHEN user_id >= 100 THEN 3 WHEN user_id >= 50 THEN 2 WHEN user_id >= 10 THEN 1 ELSE 0 END",
)
elementwise("powers", lambda x: A.product_of_powers(x.slice(0, 1), x.slice(1, 1), "1/2", "2", 0.001), "0.001 * sqrt(value) * user_id * user_id")
elementwise("sum_of_powers", lambda x: A.sum_of_powers([x.slice(0, 1), x.slice(1, 1)]), "sqrt(value * value + user_id * user_id)::FLOAT")
elementwise("cast_byte", lambda x: x.cast("byte"), "least(greatest(trunc(value), 0), 255)", "least(greatest(user_id, 0), 255)")
elementwise("round", lambda x: P.rounded(x), "round_even(value, 0)::FLOAT", "user_id::FLOAT")
elementwise("cast_int", lambda x: x.cast("int"), "trunc(value)", "user_id")
elementwise("fill_progression", lambda x: P.fill_progression(x, 1.0, 0.5, 1, 1), "value", "1 + 0.5 * event_id")
elementwise("replace_columns", lambda x: P.replace_columns(x, x, 1, 0, 1), "value", "value")
elementwise("set_number", lambda x: L.with_element(x, -7.5, 3, 1), "value", "CASE WHEN event_id = 3 THEN -7.5 ELSE user_id END")
elementwise(
    "formula", lambda x: formulas.elementwise("a > p ? a * p + b : sqrt(b)", {"a": x.slice(0, 1), "b": x.slice(1, 1)}, "double", p=20),
    "CASE WHEN value > 20 THEN value * 20 + user_id ELSE sqrt(user_id) END",
)


@query("formula_rows", f"{EV}round(value + 3 * user_id + event_id, 6) AS c0 FROM events")
def formula_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula over the rows of an array."""
    return shown(formulas.by_row("a[0] + p * a[1] + i", {"a": values(spark, sf_dir)}, "double", p=3))


for op, rule in {
    "ABSOLUTE_DIFFERENCE": "abs(value - user_id)", "POSITIVE_DIFFERENCE": "greatest(value - user_id, 0)",
    "REVERSE_POSITIVE_DIFFERENCE": "greatest(user_id - value, 0)", "SUBTRACT": "value - user_id", "REVERSE_SUBTRACT": "user_id - value",
}.items():
    elementwise(f"difference_{op.lower()}", lambda x, op=op: A.difference(x.slice(0, 1), x.slice(1, 1), op, "double"), rule)
elementwise("max_numbers", lambda x: A.extreme([x.slice(0, 1), x.slice(1, 1)], True), "greatest(value, user_id)")
elementwise("min_numbers", lambda x: A.extreme([x.slice(0, 1), x.slice(1, 1)], False), "least(value, user_id)")
elementwise(
    "equality", lambda x: A.equality(x.cast("int").slice(0, 1), x.slice(1, 1), 7, 3, kind="int"),
    "CASE WHEN trunc(value) = user_id THEN 7 ELSE 3 END",
)
for fn in ("sin", "cos", "tan", "atan"):
    elementwise(f"trig_{fn}", lambda x, fn=fn: A.trigonometry(x.slice(1, 1), fn, degrees=fn == "atan"), "0")
    angle = "degrees(atan(user_id))" if fn == "atan" else f"{fn}(user_id)"
    ORACLES[f"trig_{fn}"] = f"{EV}round({angle}::FLOAT::DOUBLE, 5) AS user_id FROM events"
    QUERIES[f"trig_{fn}"] = lambda spark, sf_dir, fn=fn: shown(
        A.trigonometry(values(spark, sf_dir).slice(1, 1), fn, degrees=fn == "atan"), 5
    )


@query("polar", f"{EV}round(sqrt(v * v + u * u)::FLOAT::DOUBLE, 4) AS r, round(atan2(u, v)::FLOAT::DOUBLE, 5) AS fi FROM (SELECT event_id, value::FLOAT::DOUBLE AS v, user_id::DOUBLE AS u FROM events)")
def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and angle of (value, user_id)."""
    x = values(spark, sf_dir)
    found = A.polar(x.slice(0, 1), x.slice(1, 1))
    return found.df.select("_i", F.round(F.col("r").cast("double"), 4).alias("r"), F.round(F.col("fi").cast("double"), 5).alias("fi"))


@query("cartesian", f"{EV}round((v * cos(radians(u)))::FLOAT::DOUBLE, 4) AS x, round((v * sin(radians(u)))::FLOAT::DOUBLE, 4) AS y FROM (SELECT event_id, value::FLOAT::DOUBLE AS v, user_id::DOUBLE AS u FROM events)")
def cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at angle user_id (degrees) and radius value."""
    x = values(spark, sf_dir)
    return shown(A.cartesian(x.slice(0, 1), x.slice(1, 1), "MULTIPLIER_TO_RADIANS"), 4)


@query("check_in_range", "SELECT bool_and(value BETWEEN 0 AND 1e9) AS ok FROM events")
def check_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all values are in a range."""
    found = A.check_in_range(values(spark, sf_dir).slice(0, 1), 0, 1e9, on_fail="RETURN_FALSE")
    return spark.range(1).select(F.lit(found).alias("ok"))


@query("check_equality", "SELECT true AS same, false AS other")
def check_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array equals itself and not its negative."""
    x = parts(spark, sf_dir)
    return spark.range(1).select(F.lit(A.all_equal(x, x)).alias("same"), F.lit(A.all_equal(x, A.negated(x).cast("double"))).alias("other"))


@query("scale_columns", "SELECT p_partkey AS _i, round(p_size * 0.5, 6) AS size FROM part")
def scale_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns times weights by name; zero weights drop a column."""
    return shown(A.scaled_columns(parts(spark, sf_dir), {"price": 0, "size": 0.5}, ["price", "size"], drop_zero=True))


@query("extract_rows", "SELECT p_partkey - 5 AS _i, p_retailprice, p_size::DOUBLE AS p_size FROM part WHERE p_partkey BETWEEN 5 AND 24")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 5 to 24, numbered anew."""
    return shown(P.extract(parts(spark, sf_dir), 5, 20))


@query("columns_by_number", "SELECT p_partkey AS _i, p_size::DOUBLE AS c0, p_retailprice AS c1 FROM part")
def columns_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last column and the first."""
    return shown(P.columns_by_name(parts(spark, sf_dir), ["price", "size"], "-1, 1")[0])


@query("split_columns", "SELECT p_partkey AS _i, p_size::DOUBLE AS p_size FROM part")
def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of the separate columns."""
    return shown(P.split_columns(parts(spark, sf_dir))[1])


@query("keep_in_range", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _i, p_retailprice, p_size::DOUBLE AS p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def keep_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a range of a column, with new positions."""
    return shown(P.renumbered(P.keep_in_range(parts(spark, sf_dir), 10, 20, 1)))


@query("keep_by_selector", "SELECT p_partkey AS _i, p_retailprice FROM part WHERE NOT p_size BETWEEN 10 AND 40")
def keep_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a range of another array, inverted."""
    x = parts(spark, sf_dir)
    return shown(P.keep_in_range(x.slice(0, 1), 10, 40, 0, True, x.slice(1, 1)))


@query("merge_rows", "SELECT p_partkey AS _i, p_retailprice FROM part UNION ALL SELECT p_partkey + (SELECT count(*) FROM part), p_size FROM part")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns one after the other."""
    x = parts(spark, sf_dir)
    return shown(P.merge_rows([x.slice(0, 1), None, x.slice(1, 1)]))


@query("merge_columns", "SELECT p_partkey AS _i, p_size::DOUBLE AS c0, c_acctbal AS c1 FROM part JOIN customer ON p_partkey = c_custkey")
def merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables side by side by position."""
    y = array(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])
    return shown(P.merge_columns([parts(spark, sf_dir).slice(1, 1), y]))


@query("replace_rows", "SELECT a.p_partkey AS _i, coalesce(b.p_size, a.p_retailprice) AS p_retailprice FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 10 AND a.p_partkey BETWEEN 10 AND 29")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows overwritten."""
    x = parts(spark, sf_dir)
    return shown(P.replace_rows(x.slice(0, 1), x.slice(1, 1), 10, 0, 20))


@query("json_numbers", """SELECT event_id, k AS key, coalesce(try_cast(props ->> k AS DOUBLE), 'nan'::DOUBLE) AS value
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of JSON objects with their keys."""
    return P.json_numbers("props", table(spark, sf_dir, "events"), "event_id").drop("position")


@query("numbers_json", """SELECT '{"a":' || max(CASE WHEN r_regionkey = 0 THEN r_regionkey END) || ',"b":' || max(CASE WHEN r_regionkey = 1 THEN r_regionkey END) || '}' AS json FROM region""")
def numbers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array as a JSON object."""
    return P.numbers_json(array(table(spark, sf_dir, "region"), "r_regionkey", ["r_regionkey"]), ["a", "b"], "INTEGER")


@query("progression", "SELECT i AS _i, 2 + 0.25 * i AS c0, 2 + 0.25 * i AS c1 FROM range(1000) t(i)")
def progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arithmetic progression."""
    return shown(P.progression(spark, 1000, 2.0, 0.25, 2))


@query("numbers_from_text", "SELECT * FROM (VALUES (0, 1.0, 2.5), (1, -3.0, 4.0)) t(_i, c0, c1)")
def numbers_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text in rows of two."""
    return shown(P.from_text(spark, "1, 2.5; -3\n4", 2, kind="double"))


@query("rectangle", "SELECT * FROM (VALUES (0, 10.0, 19.0), (1, 5.0, 100.0)) t(_i, c0, c1)")
def rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area by size and by limits."""
    return shown(P.rectangle(spark, [(10, None, 10), (5, 100, None)]))


@query("random_numbers")
def random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform numbers; only their range is defined."""
    x = P.random_numbers(spark, 1000, 2.0, 3.0, 5)
    return x.df.select((F.col("c0").between(2.0, 3.0)).alias("inside")).groupBy("inside").count()


@query("get_number", "SELECT p_size::DOUBLE AS value FROM part WHERE p_partkey = 7")
def get_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element by its flat index."""
    return L.element(parts(spark, sf_dir), raw=15)


SORTED = "SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) - 1 AS k FROM part"


@query("sort", f"SELECT k AS _i, p_retailprice, p_size::DOUBLE AS p_size FROM ({SORTED})")
def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by size, descending."""
    return shown(L.sort(parts(spark, sf_dir), 1, True)[0])


@query("sort_places", f"SELECT p_partkey AS _i, k + 1 AS c0 FROM ({SORTED})")
def sort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place that each row takes."""
    return L.sort(parts(spark, sf_dir), 1, True)[2].df


@query("invert_table", "SELECT g AS _i, coalesce(k + 1, -1) AS c0 FROM range((SELECT max(p_size) FROM part)) t(g) LEFT JOIN (SELECT p_size - 1 AS s, min(p_partkey) AS k FROM part GROUP BY 1) ON g = s")
def invert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each size."""
    return L.invert_table(array(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], "int")).df


@query("translate", "SELECT p_partkey AS _i, coalesce(c_acctbal, -1) AS c0 FROM part LEFT JOIN customer ON p_size - 1 = c_custkey")
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances looked up by size."""
    t = array(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])
    return shown(L.translate(parts(spark, sf_dir).slice(1, 1), [t], replacement=-1)[0])


@query("nearest_centre", """WITH v AS (SELECT vec_id, embedding FROM embeddings), c AS (SELECT * FROM v WHERE vec_id < 5),
    d AS (SELECT v.vec_id AS _i, c.vec_id + 1 AS k, round(sqrt(list_sum(list_transform(range(1, 65), lambda j: pow(v.embedding[j]::DOUBLE - c.embedding[j]::DOUBLE, 2))) / 64), 9) AS dist FROM v, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY _i ORDER BY dist, k DESC) AS n FROM d)
    SELECT _i, k::DOUBLE AS "index", round(dist, 6) AS distance FROM r WHERE n = 1""")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of five centres for every vector."""
    rows = table(spark, sf_dir, "embeddings")
    wide = rows.select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])
    x = array(wide, "vec_id", [f"e{k}" for k in range(64)])
    found = L.nearest_centres(x, Numbers(x.df.where("_i < 5"), x.columns, x.kind))
    return found.df.select("_i", F.col("index").cast("double").alias("index"), F.round("distance", 6).alias("distance"))


@query("set_length", "SELECT g AS _i, coalesce(p_size, 0)::DOUBLE AS p_size FROM range(2500) t(g) LEFT JOIN part ON g = p_partkey")
def set_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array padded to a fixed length."""
    return shown(L.set_length([parts(spark, sf_dir).slice(1, 1)], 2500, 2500, 0.0)[0])


@query("numbers_info", """SELECT count(*) AS n, 1 AS block_length, count(*) AS array_length, round(avg(value), 6) AS mean, round(sum(value), 3) AS sum,
    min(value) AS min, max(value) AS max, max(abs(value)) AS max_abs FROM events""")
def numbers_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean, sum and extremes."""
    found = T.info(values(spark, sf_dir).slice(0, 1))
    return found.select("n", "block_length", "array_length", F.round("mean", 6).alias("mean"), F.round("sum", 3).alias("sum"), "min", "max", "max_abs")


@query("column_statistics", """SELECT 0 AS "column", count(*) AS n, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 5) AS deviation FROM events
    UNION ALL SELECT 1, count(*), round(var_pop(user_id), 4), round(stddev_pop(user_id), 5) FROM events""")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and deviation by column."""
    found = T.column_statistics(values(spark, sf_dir))
    return found.select("column", "n", F.round("variance", 4).alias("variance"), F.round("standard_deviation", 5).alias("deviation"))


@query("percentiles", """WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)
    SELECT level, v AS value FROM r, (VALUES (0.0), (0.25), (0.5), (0.9), (1.0)) t(level) WHERE k = floor(level * (n - 1) + 0.5)""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), "l_extendedprice")
    return T.percentiles(array(rows, "k", ["l_extendedprice"]), [0.0, 0.25, 0.5, 0.9, 1.0])


@query("histogram", "SELECT g AS bin, count(l_quantity) AS n FROM range(10) t(g) LEFT JOIN lineitem ON floor(l_quantity / 6) = g GROUP BY g")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of the quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), "l_quantity")
    return T.histogram(array(rows, "k", ["l_quantity"]), 10, 0.0, 60.0)


@query("contrast", "SELECT p_partkey AS _i, round(least(greatest((p_size - 5.0) / 30, 0), 1), 6) AS p_size FROM part")
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes 5..35 stretched to 0..1."""
    return shown(T.contrast(parts(spark, sf_dir).slice(1, 1), 5, 35, "ABSOLUTE_VALUE", "ABSOLUTE_VALUE")[0])


@query("contrast_share", """SELECT p_partkey AS _i, round((p_size - lo) / (hi - lo)::DOUBLE * 255, 4) AS p_size FROM part,
    (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)""")
def contrast_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole range stretched to 0..255."""
    return shown(T.contrast(parts(spark, sf_dir).slice(1, 1), 0, 1, "VALUE_BETWEEN_MIN_AND_MAX", "VALUE_BETWEEN_MIN_AND_MAX", 0, 255)[0], 4)


@query("numbered", """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS _i,
    l_orderkey, l_linenumber FROM lineitem""")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of lineitem rows without a global window."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return numbered(table(spark, sf_dir, "lineitem").select(*keys), keys).select("_i", "l_orderkey", "l_linenumber")


def scalar(name: str, source: str, key: str, exprs: Callable[[], dict], sql: str) -> None:
    """Register scalar functions over a table."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(key, *[e.alias(n) for n, e in exprs().items()])
    ORACLES[name] = f"SELECT {key}, {sql} FROM {source}"


C = F.col
scalar(
    "scalar_arithmetic", "part", "p_partkey",
    lambda: {
        "lin": F.round(S.linear(C("p_size"), C("p_retailprice"), 2.0, 0.5, 1.0), 6),
        "pow": F.round(S.product_of_powers(C("p_size"), None, "1/2", m=3.0), 6),
        "rint": S.rounded(C("p_retailprice"), "EVEN_ROUND_TO_LONG"),
        "fl": S.rounded(C("p_retailprice"), "FLOOR_TO_DOUBLE"),
        "up": S.rounded(C("p_retailprice"), "ROUND_TO_LONG"),
        "cut": S.truncated(C("p_size"), 10, 20)[0],
        "most": S.extreme([C("p_size"), C("p_retailprice")], True, 1200),
    },
    """round(2.0 * p_size + 0.5 * p_retailprice + 1, 6) AS lin, round(3 * sqrt(p_size), 6) AS pow, round_even(p_retailprice, 0)::BIGINT AS rint,
       floor(p_retailprice) AS fl, floor(p_retailprice + 0.5)::BIGINT AS up, least(greatest(p_size::DOUBLE, 10), 20) AS cut,
       greatest(p_size, p_retailprice, 1200) AS most""",
)
scalar(
    "scalar_compare", "part", "p_partkey",
    lambda: {
        **{k: v for k, v in S.compare(C("p_size"), F.lit("25")).items()},
        "ranged": S.in_range(C("p_size"), 5, 15, True, "C_LIKE"),
        "constant": S.range_to_constant(C("p_size").cast("string"), None, 9, "small"),
    },
    """(p_size = 25)::VARCHAR AS equal, (p_size <> 25)::VARCHAR AS non_equal, (p_size < 25)::VARCHAR AS less, (p_size <= 25)::VARCHAR AS less_or_equal,
       (p_size > 25)::VARCHAR AS greater, (p_size >= 25)::VARCHAR AS greater_or_equal, CASE WHEN p_size BETWEEN 5 AND 15 THEN '0' ELSE '1' END AS ranged,
       CASE WHEN p_size <= 9 THEN 'small' ELSE p_size::VARCHAR END AS "constant" """,
)
scalar(
    "scalar_text", "documents", "doc_id",
    lambda: {
        "len": S.length(C("lang")),
        "joined": S.concatenated([C("lang"), C("source")], "/"),
        "put": S.concatenated([C("lang"), C("source")], pattern="{2}:{1}"),
        "inside": S.inserted(C("source"), "from $$$ here"),
        "second": S.split(C("source"), "c", 1),
        "same": S.same(C("lang"), F.lit("en")),
    },
    """length(lang) AS len, lang || '/' || source AS joined, source || ':' || lang AS put, 'from ' || source || ' here' AS inside,
       string_split(source, 'c')[2] AS second, (lang = 'en')::VARCHAR AS same""",
)
scalar(
    "scalar_logic", "labels", "doc_id",
    lambda: {
        "both": S.and_all([C("quality"), C("toxic")]),
        "either": S.or_all([C("quality"), C("toxic")], True),
        "differ": S.logical(C("quality"), C("toxic"), "XOR"),
        "alike": S.logical(C("quality"), C("toxic"), "EQUIVALENCE", "C_LIKE"),
        "without": S.logical(C("quality"), C("toxic"), "AND_NOT"),
        "negative": S.logical(C("quality"), None, "NOT"),
    },
    """(quality = 1 AND toxic = 1)::VARCHAR AS "both", (NOT (quality = 1 OR toxic = 1))::VARCHAR AS either, (quality <> toxic)::VARCHAR AS differ,
       CASE WHEN quality = toxic THEN '1' ELSE '0' END AS alike, (quality = 1 AND toxic = 0)::VARCHAR AS without, (quality = 0)::VARCHAR AS negative""",
)
scalar(
    "scalar_flow", "labels", "doc_id",
    lambda: {
        "picked": S.chosen(C("toxic"), F.lit("bad"), F.lit("fine"), "C_LIKE"),
        "switched": S.switched(C("quality"), [F.lit("one"), F.lit("two")]),
    },
    """CASE WHEN toxic = 1 THEN 'bad' ELSE 'fine' END AS picked, 'one' AS switched""",
)
scalar(
    "json_values", "events", "event_id",
    lambda: {"keys": S.json_keys(C("props")), "missing": S.json_value(C("props"), "nothing", "none")},
    """array_to_string(json_keys(props), chr(10)) AS "keys", 'none' AS missing""",
)


@query("rows_that_go_on", "SELECT doc_id FROM labels WHERE toxic = 0")
def rows_that_go_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row form of cancelling."""
    return table(spark, sf_dir, "labels").where(S.rows_if(C("toxic"), style="C_LIKE")).select("doc_id")


W, H = 40, 30
GRID = f"SELECT (i % {W})::INT AS x, (i // {W})::INT AS y FROM range({W * H}) t(i)"
BASE = f"SELECT x, y, (x * 6) % 256 AS ch0, (y * 8) % 256 AS ch1, (x * y) % 256 AS ch2 FROM ({GRID})"


def base(spark: SparkSession) -> Matrix:
    """A colour gradient of bytes."""
    return grid(spark, W, H, [F.col("x") * 6 % 256, F.col("y") * 8 % 256, F.col("x") * F.col("y") % 256])


def matrix(name: str, f: Callable[[Matrix], Matrix], sql: str, rows: str = BASE, digits: int = 5) -> None:
    """Register a matrix operator on the gradient."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = f(base(spark))
        return m.df.select(*m.axes, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in m.names])

    QUERIES[name] = run
    ORACLES[name] = f"SELECT x, y, {sql} FROM ({rows})"


def each(rule: str) -> str:
    """One rule for three channels."""
    return ", ".join(f"round(({rule.replace('$', f'ch{k}')})::DOUBLE, 5) AS ch{k}" for k in range(3))


matrix("matrix_abs", M.absolute, each("abs($)"))
matrix("matrix_invert", M.inverted, each("255 - $"))
matrix("matrix_cut", lambda m: M.cut(m, 0.2, 0.6), each("trunc(least(greatest($::DOUBLE, 0.2 * 255), 0.6 * 255))"))
matrix("matrix_linear", lambda m: M.linear([m, m], [0.5, 0.25], 0.1), each("trunc(least(0.75 * $ + 25.5, 255))"))
matrix("matrix_difference", lambda m: M.difference(m, M.inverted(m), "POSITIVE_DIFFERENCE"), each("greatest(2 * $ - 255, 0)"))
matrix("matrix_max", lambda m: M.extreme([m, M.inverted(m)], True), each("greatest($, 255 - $)"))
matrix("matrix_min", lambda m: M.extreme([m, M.inverted(m)], False), each("least($, 255 - $)"))
matrix("matrix_product", lambda m: M.product_of_powers(M.precision(m, "float"), M.precision(m, "float"), "1", "2"), each("pow(($ / 255.0::DOUBLE)::FLOAT::DOUBLE, 3)::FLOAT"))
matrix("matrix_sum_of_powers", lambda m: M.sum_of_powers([M.precision(m, "float")] * 2), each("($ / 255.0::DOUBLE)::FLOAT"))
matrix("matrix_intensity", M.intensity, "floor(0.299::DOUBLE * ch0 + 0.587::DOUBLE * ch1 + 0.114::DOUBLE * ch2 + 0.5)::DOUBLE AS ch0")
matrix("matrix_precision", lambda m: M.precision(m, "short"), each("$ * 257"))
matrix("matrix_non_zero", M.non_zero, "(ch0 <> 0 OR ch1 <> 0 OR ch2 <> 0)::INT::DOUBLE AS ch0")
matrix("matrix_find", lambda m: M.find_value(m, "EQUAL_TO_RAW_CUSTOM", 0), "(ch0 = 0 AND ch1 = 0 AND ch2 = 0)::INT::DOUBLE AS ch0")
matrix("matrix_mask", lambda m: M.masked(m, m.of([F.col("x") > 9], "boolean"), filler="#FF0000"), "CASE WHEN x > 9 THEN ch0 ELSE 255 END::DOUBLE AS ch0, CASE WHEN x > 9 THEN ch1 ELSE 0 END::DOUBLE AS ch1, CASE WHEN x > 9 THEN ch2 ELSE 0 END::DOUBLE AS ch2")
matrix("matrix_fill", lambda m: M.filled(m, 2, 3, 10, 12, "[10,20,30]"), ", ".join(f"CASE WHEN x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 12 THEN {v} ELSE ch{k} END::DOUBLE AS ch{k}" for k, v in enumerate((10, 20, 30))))
matrix("matrix_channels", lambda m: M.channel_group(m, 2, 2), "ch2::DOUBLE AS ch0, 0::DOUBLE AS ch1")
matrix("matrix_merge_channels", lambda m: M.merge_channels([M.split_channels(m)[2], M.split_channels(m)[0]]), "ch2::DOUBLE AS ch0, ch0::DOUBLE AS ch1")
matrix("matrix_labels", lambda m: M.merge_masks([m.of([F.col("ch0") > 100], "boolean"), m.of([F.col("ch1") > 100], "boolean")]), "CASE WHEN ch1 > 100 THEN 2 WHEN ch0 > 100 THEN 1 ELSE 0 END::DOUBLE AS ch0")
matrix("matrix_select", lambda m: M.selected(m.of([F.col("x") % 2], "int"), [m, M.inverted(m)]), each("CASE WHEN x % 2 = 0 THEN $ ELSE 255 - $ END"))
matrix("matrix_equality", lambda m: M.equality(m, m.of([F.col("ch0"), F.col("ch1"), F.lit(0)])), "CASE WHEN ch2 = 0 THEN 0 ELSE ch0 END::DOUBLE AS ch0, CASE WHEN ch2 = 0 THEN 0 ELSE ch1 END::DOUBLE AS ch1, 0::DOUBLE AS ch2")
matrix("matrix_shift", lambda m: M.shifted(m, 7, -4), each("$"), f"SELECT (x + 7) % {W} AS x, (y - 4 + {H}) % {H} AS y, ch0, ch1, ch2 FROM ({BASE})")
matrix("matrix_crop", lambda m: M.cropped(m, 5, 6, 10, 8), each("$"), f"SELECT x - 5 AS x, y - 6 AS y, ch0, ch1, ch2 FROM ({BASE}) WHERE x BETWEEN 5 AND 14 AND y BETWEEN 6 AND 13")
matrix("matrix_extend", lambda m: M.cropped(m, -2, -2, W + 4, H + 4, "ZERO_CONSTANT"), each("coalesce($, 0)"), f"SELECT a.x, a.y, ch0, ch1, ch2 FROM (SELECT (i % {W + 4})::INT AS x, (i // {W + 4})::INT AS y FROM range({(W + 4) * (H + 4)}) t(i)) a LEFT JOIN ({BASE}) b ON a.x - 2 = b.x AND a.y - 2 = b.y")
matrix("matrix_resize", lambda m: M.resized(m, W // 2, H // 2), each("floor($ + 0.5)"), f"SELECT x // 2 AS x, y // 2 AS y, avg(ch0) AS ch0, avg(ch1) AS ch1, avg(ch2) AS ch2 FROM ({BASE}) GROUP BY 1, 2")
matrix("matrix_dilate", lambda m: M.dilated(m.of([F.col("ch0")]), 3), "max(n)::DOUBLE AS ch0", f"SELECT a.x, a.y, b.ch0 AS n FROM ({BASE}) a JOIN ({BASE}) b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
ORACLES["matrix_dilate"] += " GROUP BY x, y"
matrix("matrix_arctangent", lambda m: M.arctangent(m.of([F.col("ch0") + 1], "float"), m.of([F.col("ch1")], "float")), "round((atan2(ch1, ch0 + 1) / (2 * pi()))::FLOAT::DOUBLE, 5) AS ch0")
matrix("matrix_normalise", lambda m: M.normalised_vector(m.of([F.col("ch0")], "float"), m.of([F.col("ch1")], "float"))[0], "round((CASE WHEN ch0 = 0 AND ch1 = 0 THEN 1 ELSE ch0 / sqrt(ch0 * ch0 + ch1 * ch1) END)::FLOAT::DOUBLE, 5) AS ch0")
matrix("matrix_rgb_distance", lambda m: M.difference(M.precision(m, "float"), M.precision(M.inverted(m), "float"), "RGB_DISTANCE"), "round(sqrt((pow(2 * ch0 - 255, 2) + pow(2 * ch1 - 255, 2) + pow(2 * ch2 - 255, 2)) / 3 / 65025.0)::DOUBLE, 4) AS ch0", digits=4)


@query("matrix_info", "".join(
    f"{'UNION ALL ' if k else ''}SELECT {k} AS channel, round(avg(ch{k}), 6) AS mean, sum(ch{k})::DOUBLE AS sum, min(ch{k})::DOUBLE AS min, max(ch{k})::DOUBLE AS max, "
    f"min(CASE WHEN ch{k} <> 0 THEN ch{k} END)::DOUBLE AS least_non_zero, count(CASE WHEN ch{k} <> 0 THEN 1 END) AS non_zero FROM ({BASE}) " for k in range(3)
))
def matrix_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by channel."""
    found = M.info(base(spark))
    return found.select("channel", F.round("mean", 6).alias("mean"), "sum", "min", "max", "least_non_zero", "non_zero")


@query("matrix_layers", f"SELECT x, y, z, round((ch0 * (1 - z / 3.0) + (255 - ch0) * z / 3.0)::FLOAT::DOUBLE, 3) AS ch0 FROM ({BASE}), (SELECT unnest(range(4))::INT AS z)")
def matrix_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers between a matrix and its inverse."""
    m = base(spark)
    front, rear = m.of([F.col("ch0")], "float"), m.of([255 - F.col("ch0")], "float")
    return M.interpolated(front, rear, 4).df.select("x", "y", "z", F.round(F.col("ch0").cast("double"), 3).alias("ch0"))


@query("bilinear", f"SELECT x, y, round((0.001 * (x - 20) * (x - 20) + 0.0004 * (x - 20) * (y - 15) + 0.001 * (y - 15) * (y - 15))::FLOAT::DOUBLE, 5) AS ch0 FROM ({GRID})")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of a quadratic form."""
    m = M.bilinear(spark, W, H, origin=(20, 15))
    return m.df.select("x", "y", F.round(F.col("ch0").cast("double"), 5).alias("ch0"))


@query("chain_scalar_sum", "SELECT 3.0 AS output")
def chain_scalar_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of two inputs and a linear combination."""
    blocks = [
        {"uuid": "x", "executor_name": "Input/create double scalar", "system": {"name": "x"}, "parameters": [{"name": "value", "value": 20.0}], "ports": [{"uuid": "x.out", "type": 2, "name": "output"}]},
        {"uuid": "y", "executor_name": "Input/create double scalar", "system": {"name": "y"}, "parameters": [{"name": "value", "value": 10.0}], "ports": [{"uuid": "y.out", "type": 2, "name": "output"}]},
        {"uuid": "sum", "executor_name": "Scalar ax + by + Δ", "parameters": [{"name": "a", "value": 0.1}, {"name": "b", "value": 0.1}], "ports": [{"uuid": "sum.x", "type": 1, "name": "x"}, {"uuid": "sum.y", "type": 1, "name": "y"}, {"uuid": "sum.out", "type": 2, "name": "output"}]},
        {"uuid": "out", "executor_name": "Output scalar", "system": {"name": "output"}, "ports": [{"uuid": "out.in", "type": 1, "name": "input"}]},
    ]
    links = [{"src_port_uuid": a, "dest_port_uuid": b} for a, b in (("x.out", "sum.x"), ("y.out", "sum.y"), ("sum.out", "out.in"))]
    import json

    found = chains.Chain.read(json.dumps({"blocks": blocks, "links": links})).run(chains.scalar_registry())
    return spark.range(1).select(F.lit(found["output"]).alias("output"))


@query("literal_array", "SELECT * FROM (VALUES (0, 255.0, 0.0), (1, 3.0, 65.0)) t(_i, c0, c1)")
def literal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cast to unsigned bytes."""
    return shown(literal_array(spark, [[300.0, -5.0], [3.9, 65.0]]).cast("byte"))
