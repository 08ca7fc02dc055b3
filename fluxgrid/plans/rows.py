"""Registered queries of flow, files, settings, scripts, drawing, colours and chains, with their SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.model import Matrix, array
from fluxgrid.operators import arithmetic as A
from fluxgrid.operators import constants, drawing, examples, flow, tables
from fluxgrid.operators import matrices as M
from fluxgrid.operators import shapes as P
from fluxgrid.operators import statistics as T
from fluxgrid.operators import vectors as V
from fluxgrid.plans import chains, scripts, settings, system
from fluxgrid.plans.catalogue import BASE, EV, FLAGSHIP, ORACLES, QUERIES, C, H, W, base, each, elementwise, matrix, parts, query, scalar, shown, table, values
from fluxgrid.sources import files, folders
from fluxgrid.storage import shared_dir

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]


def literal(spark: SparkSession, **columns) -> DataFrame:
    """One row of driver values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as a path that the driver's file functions take."""
    import uuid

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return path.removeprefix("file://").removeprefix("file:")


# values with NaN, longer and missing inputs

elementwise("replace_real_nan", lambda x: A.replace_nan(x.with_columns({c: F.when(F.col(c) < 20, float("nan")).otherwise(F.col(c)) for c in x.columns}), -1.0),
            "CASE WHEN value < 20 THEN -1 ELSE value::FLOAT END", "CASE WHEN user_id < 20 THEN -1 ELSE user_id::FLOAT END")
elementwise("copy_numbers", lambda x: flow.redirect(x, 2)[1], "value", "user_id")
elementwise("choose_numbers", lambda x: flow.choose("1", lambda: A.negated(x), None, "C_LIKE"), "(-value)::FLOAT", "(-user_id)::FLOAT")
elementwise("switch_numbers", lambda x: flow.switch(0, [None, lambda: x.slice(1, 1)]), "0")
ORACLES["switch_numbers"] = f"{EV}user_id::DOUBLE AS user_id FROM events"
elementwise("named_assignments", lambda x: scripts.modify_named(x, ["a", "b"], "a = b * p; x1 += i", p=3), "3 * user_id", "user_id + event_id")
elementwise("several_assignments", lambda x: scripts.modify_several({"a": x, "b": x.slice(0, 1)}, "a[0] = a[0] * p + k; b[0] = a[1]", p=2)["a"], "2 * value + event_id", "user_id")
elementwise("python_by_batches", lambda x: scripts.call_by_batches(x, lambda f: f.assign(value=f["value"] * 2), ["value", "user_id"]), "2 * value", "user_id")
elementwise("named_columns", lambda x: tables.named_columns([(x.slice(0, 1), ["v"]), (x, ["w", "u"])], ["v", "u"]).with_columns({"value": F.col("v"), "user_id": F.col("u")}), "value", "user_id")


elementwise("script_of_branches", lambda x: scripts.modify_named(x, ["a", "b"], "function cut(v, high) { if (v > high) { return high } return v }\nif (a > 50 && b < 60) { a = cut(a * 2, 150) } else if (b >= 60) a = -1\nfor (var j = 0; j < 3; j++) b += j"),
            "CASE WHEN value > 50 AND user_id < 60 THEN least(value * 2, 150) WHEN user_id >= 60 THEN -1 ELSE value END", "user_id + 3")
elementwise("example_doubled", lambda x: examples.doubled(x.df.sparkSession, x), "2 * value", "2 * user_id")


@query("script_on_the_driver", "SELECT '0; 1; 3; 8' AS list, 'SUM' AS text, 83.0 AS output")
def script_on_the_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with functions, loops, arrays and texts."""
    text = """function fib(n) { return n < 2 ? n : fib(n - 1) + fib(n - 2) }
    function execute(params, inputs, outputs) {
        let list = []
        for (let k = 0; k < params.n; k++) { if (k % 2) continue; list.push(fib(k)) }
        outputs.list = list.join("; ")
        outputs.text = inputs.name.toUpperCase()
        return 9 ** 2 + [1, 2][1]
    }"""
    return literal(spark, **scripts.use(text, {"n": 7.0}, {"name": "sum"}))


@query("numbers_are_equal", "SELECT true AS copied, count(*) FILTER (value <> value) = 0 AS same FROM events")
def numbers_are_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array against its copy in another plan."""
    x, y = values(spark, sf_dir), values(spark, sf_dir)
    return literal(spark, copied=A.check_equal(x, y), same=A.all_equal(A.linear(x, x, 2.0, -1.0), y))


@query("numbers_length", "SELECT count(*) AS length, 2 * count(*) AS elements FROM events")
def numbers_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and elements."""
    x = values(spark, sf_dir)
    return tables.length(x).crossJoin(tables.length(x, True).withColumnRenamed("length", "elements"))


@query("number_lines", "SELECT n_nationkey AS _i, (n_nationkey + 1)::VARCHAR || ': ' || n_nationkey || '; ' || n_regionkey AS line FROM nation")
def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text with their numbers."""
    x = array(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])
    return tables.text_lines(x, "; ", line_numbers=True, base=1)


@query("area_scalars", "SELECT min(p_size)::DOUBLE AS min_x, max(p_size)::DOUBLE AS max_x, min(p_retailprice) AS min_y, max(p_retailprice) AS max_y FROM part")
def area_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of all parts as an array and back."""
    r = table(spark, sf_dir, "part").agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    area = P.rectangle(spark, [(r[0], r[1], None), (r[2], r[3], None)], "DOUBLE")
    return tables.area_scalars(area).select("min_x", "max_x", "min_y", "max_y")


@query("index_table", "SELECT g AS _i, CASE g WHEN 1 THEN 5 WHEN 3 THEN 9 ELSE -1 END AS c0 FROM range(6) t(g)")
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a JSON map with names."""
    return tables.index_table(spark, '{"one": 5, "3": "big"}', '{"one": 1}', '{"big": 9}', least_length=6, filler=-1).df


@query("colour_palette", "SELECT * FROM (VALUES (0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.2), (2, 0.5, 0.5, 0.5)) t(_i, c0, c1, c2)")
def colour_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours by index."""
    return shown(tables.palette(spark, '{"1": "#FF0033", "2": 0.5}'))


@query("all_statistics", """WITH v AS (SELECT value AS x FROM events UNION ALL SELECT user_id FROM events), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS n FROM v)
    SELECT round(sum(x), 3) AS sum, round(avg(x), 6) AS mean, round(var_pop(x), 3) AS variance, round(stddev_pop(x), 5) AS deviation, count(*) // 2 AS number_of_blocks, 2 AS block_length, count(*) AS array_length,
      max(CASE WHEN k = floor(0.5 * (n - 1) + 0.5) THEN x END) AS median, max(CASE WHEN k = floor(0.9 * (n - 1) + 0.5) THEN x END) AS upper, count(*) FILTER (x >= 0 AND x < 50) AS first_bar FROM r""")
def all_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of statistics."""
    found = T.all_statistics(values(spark, sf_dir), [0.5, 0.9], 10, 0.0, 500.0)
    return found.select(
        F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"), F.round("standard_deviation", 5).alias("deviation"), "number_of_blocks", "block_length",
        "array_length", F.col("percentiles")[0].alias("median"), F.col("percentiles")[1].alias("upper"), F.col("histogram")[0].alias("first_bar"),
    )


# files

PART = "SELECT p_partkey AS _i, p_retailprice AS c0, p_size::DOUBLE AS c1 FROM part"


@query("csv_round_trip", PART)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array written as CSV and read again."""
    folder = own_folder(spark, "csv")
    files.write_csv(parts(spark, sf_dir), folder, ["price", "size"])
    return files.read_csv(spark, folder, "double")[0].df


@query("raw_round_trip", PART)
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array written as raw bytes and read again."""
    folder = own_folder(spark, "raw")
    files.write_raw(parts(spark, sf_dir), folder, metadata=True, names=["price", "size"])
    return files.read_raw(spark, folder, 2, "double", glob="*.raw").df


@query("text_round_trip", "SELECT 'first line\nsecond' AS text, 'none' AS missing, '5' AS number")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar and a JSON object written and read again."""
    folder = folders.create_folder(own_folder(spark, "text"))
    constants.write_scalar("first line\nsecond", folder + "a.txt")
    constants.write_scalar(constants.create_json('{"k": 5}'), folder + "a.json")
    found = json.loads(files.read_json(spark, folder + "a.json"))
    return literal(spark, text=files.read_scalar(spark, folder + "a.txt"), missing=files.read_scalar(spark, folder + "b.txt", "none"), number=constants.create_integer(found["k"]))


@query("next_scalars", "SELECT * FROM (VALUES ('a', 'text of a', 0, 2), ('b', 'text of b', 1, 2)) t(name, text, file_index, number_of_files)")
def next_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a folder in the order of their paths."""
    folder = folders.create_folder(own_folder(spark, "texts"))
    for name in "ba":
        constants.write_scalar(f"text of {name}", f"{folder}{name}.txt")
    constants.write_scalar("other", f"{folder}c.json")
    rows = files.scalars_in_folder(spark, folder)
    return rows.select(F.regexp_extract("path", r"(\w)\.txt$", 1).alias("name"), "text", "file_index", "number_of_files")


@query("folder_operators", "SELECT 'a.txt,b.txt,d.csv' AS listed, '1' AS there, '0' AS gone, 2 AS removed, 'a.txt,b.txt,a.txt' AS steps, 'x.csv' AS renamed, 'd.csv' AS moved")
def folder_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made, listed, stepped through, copied, moved and removed."""
    folder = folders.create_folder(own_folder(spark, "files"))
    inner = folders.create_folder(folder + "inner")
    for name in ("b.txt", "a.txt", "d.csv"):
        constants.write_scalar(name, folder + name)
    names = lambda paths: ",".join(os.path.basename(p) for p in paths)
    listed = names(folders.list_of_files(folder))
    there = folders.existence(folder + "a.txt")["output"]
    steps = folders.FileIterator(folders.list_of_files(folder, "*.txt"))
    taken = names(steps.step()["output"] for _ in range(3))
    moved = names(folders.copy_or_move(folder, inner, "*.csv", move=True))
    removed = folders.remove_files(folder, "*.{txt,csv}")
    folders.remove_folder(folder)
    gone = folders.existence(folder)["output"]
    return literal(spark, listed=listed, there=there, gone=gone, removed=removed, steps=taken, renamed=folders.changed_extension("x.txt", "csv"), moved=moved)


@query("paths", "SELECT 'c.txt' AS file_name, true AS inside, true AS refused")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child path, and one that leaves its parent."""
    found = folders.resolve(sf_dir, "a/c.txt")
    try:
        folders.resolve(sf_dir, "../c.txt")
        refused = False
    except ValueError:
        refused = True
    return literal(spark, file_name=found["file_name"], inside=found["absolute_path"].startswith(os.path.abspath(sf_dir)), refused=refused)


def stored_matrix(name: str, write, read) -> None:
    """Register a round trip of the gradient through files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = folders.create_folder(own_folder(spark, name))
        write(base(spark), folder + "m.png")
        m = read(spark, folder + "m.png")
        return m.df.select("x", "y", *[F.col(c).cast("double").alias(c) for c in m.names])

    QUERIES[name] = run
    ORACLES[name] = f"SELECT x, y, ch0::DOUBLE AS ch0, ch1::DOUBLE AS ch1, ch2::DOUBLE AS ch2 FROM ({BASE})"


stored_matrix("image_round_trip", folders.write_png, folders.read_image)
stored_matrix("matrix_folder_round_trip", folders.write_matrix, folders.read_matrix)
stored_matrix("next_image", folders.write_png, lambda spark, path: folders.next_image(spark, folders.FileIterator([path]))[0])

# scalars

scalar(
    "scalar_more", "events", "event_id",
    lambda: {
        "magnitude": S.absolute(C("user_id") - 50)[0], "below": S.absolute(C("user_id") - 50)[1], "k": S.json_value(C("props"), "k", None), "third": S.numbers(F.concat_ws("; ", "user_id", "event_id", F.lit("2.5")))[2],
        "changed": S.json_with(C("props"), "m", C("user_id"), "INTEGER"), "reset": S.json_with(C("props"), "k", F.lit("x")), "switched": S.switched(C("user_id") % 4, [F.lit(None).cast("string"), F.lit("two"), C("event_type")]),
    },
    """abs(user_id - 50)::DOUBLE AS magnitude, user_id < 50 AS below, (props ->> 'k') AS k, 2.5 AS third, json_merge_patch(props, '{"m":' || user_id || '}')::VARCHAR AS changed,
       '{"k":"x"}' AS reset, CASE user_id % 4 WHEN 0 THEN 'two' WHEN 2 THEN 'two' WHEN 3 THEN event_type END AS switched""",
)


@query("nan_scalars", "SELECT event_id, event_id % 2 = 1 AS equal, event_id % 2 = 1 AS inside, CASE WHEN event_id % 2 = 1 THEN 1.0 ELSE 'nan'::DOUBLE END AS least FROM events")
def nan_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons and extremes with NaN."""
    x = F.when(F.col("event_id") % 2 == 1, "1").otherwise("NaN")
    return table(spark, sf_dir, "events").select(
        "event_id", (S.compare(x, x)["equal"] == "true").alias("equal"), (S.in_range(x, 0, None) == "true").alias("inside"), S.extreme([x, F.lit("5")], False).alias("least")
    )


@query("driver_scalars", "SELECT 'true' AS yes, '1' AS one, '2.5' AS number, '7' AS given, 'text' AS text, 'false' AS missing, 'true' AS there, 'b' AS picked, 1 AS kept, 0 AS cancelled, 1 AS refused")
def driver_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants, conditions and conditional copies on the driver."""
    refused = 0
    try:
        flow.throw_if("true", message="stop")
    except ValueError:
        refused = 1
    return literal(
        spark, yes=constants.create_boolean(True), one=constants.create_boolean(True, style="C_LIKE"), number=constants.create_double(2.5), given=constants.create_integer(5, "7"),
        text=constants.print_scalar("text", "<$$$>", "DEBUG"), missing=flow.exists(None), there=flow.exists(values(spark, sf_dir), non_empty=True), picked=flow.choose("0", "a", "b", "C_LIKE"),
        kept=len(constants.copy_if_requested({"a": 1, "b": 2}, {"a": "true"})), cancelled=len(flow.cancel_or_copy("true", {"a": 1})), refused=refused,
    )


SETTINGS = json.dumps({"name": "sum", "controls": [{"name": "a", "value_type": "double", "default": 1.0}, {"name": "on", "value_type": "boolean", "default": False}, {"name": "sub", "value_type": "settings"}]})


@query("settings", "SELECT 2.5 AS a, true AS switched, 3 AS inner_value, 'a,on,sub' AS names, 2.5 AS split, 9 AS replaced, 2.5 AS parent")
def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings combined, overridden, nested and split."""
    s = settings.Settings.read(SETTINGS)
    record = s.combine({"a": "2.5", "sub": {"v": 3}}, {"on": "true"})
    nested = settings.with_sub({"a": 1}, "sub", {"v": 9, "a": 5})
    return literal(
        spark, a=record["a"], switched=record["on"], inner_value=record["@sub"]["v"], names=",".join(s.names()), split=s.split(record)["a"], replaced=nested["@sub"]["v"],
        parent=settings.sub({**record, "@sub": {"a": 7}}, "sub")["a"],
    )


@query("mapping", "SELECT * FROM (VALUES ('RED', 'warm'), ('BLUE', 'cold'), ('1', 'none'), ('2', 'none'), ('3', 'cold')) t(key, value)")
def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping record over named keys and a range."""
    found = settings.mapping_record("RED // red\nBLUE\n1..3 // number $$$", {"RED": "warm", "BLUE": "cold", "3": "cold"}, "none", "warm\ncold\nnone")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in found.items()])))


@query("scripts", "SELECT 12.0 AS formula, 128.0 AS repeated, 7 AS rounds, true AS known, false AS unknown, 'OFF' AS level, false AS logged")
def scripts_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar formula, a loop, module and level checks."""
    loop = scripts.repeat({"a": 1}, "a *= 2", "a < 100")
    level, logged = system.log_level("OFF")
    return literal(spark, formula=scripts.scalar_formula(spark, "a > 1 ? a * b : 0", a="3", b=4), repeated=float(loop["a"]), rounds=loop["i"], known=system.class_exists("json"), unknown=system.class_exists("no.such"), level=level, logged=logged)


# matrices: vectors, colours, statistics, sizes

matrix("example_created", lambda m: examples.created(m.df.sparkSession, W, H, 3), ", ".join(f"(((y * {W} + x) * 3 + {c}) * {c + 1}) % 256::DOUBLE AS ch{c}" for c in range(3)))
matrix("example_increased", lambda m: examples.increased(m, 70), each("($ + 70) % 256"))
matrix("example_function", lambda m: examples.function_of_place(m.df.sparkSession, W, H), ", ".join(f"floor(CASE WHEN y < {H / 4} THEN x WHEN y < {H / 2} THEN {'x / 2.0' if c == 0 else '0'} ELSE x * y * {c + 1} / 10.0 END)::BIGINT % 256::DOUBLE AS ch{c}" for c in range(3)))

VX, VY = "(ch0 - 100.0)", "(ch1 - 100.0)"


def vector(m: Matrix) -> tuple[Matrix, Matrix]:
    """A vector field of the gradient."""
    return m.of([F.col("ch0") - 100.0], "float"), m.of([F.col("ch1") - 100.0], "float")


matrix("matrix_angle", lambda m: V.angle_difference(*vector(m), *vector(m)[::-1], "SIN"), f"round((CASE WHEN {VX} = 0 AND {VY} = 0 THEN 0 ELSE abs({VX} * {VX} - {VY} * {VY}) / ({VX} * {VX} + {VY} * {VY}) END)::FLOAT::DOUBLE, 4) AS ch0", digits=4)
matrix("matrix_double_angle", lambda m: V.double_angle(*vector(m))[0], f"round((CASE WHEN {VX} = 0 AND {VY} = 0 THEN 1 ELSE ({VX} * {VX} - {VY} * {VY}) / sqrt({VX} * {VX} + {VY} * {VY}) END)::FLOAT::DOUBLE, 3) AS ch0", digits=3)
matrix("matrix_from_pair", lambda m: V.difference_from_pair(m, M.inverted(m), m.of([F.lit(0.0)] * 3), "RGB_DISTANCE_DIVIDED_BY_SUM"),
       "round((CASE WHEN p + q = 0 THEN 0 ELSE p / (p + q) END)::FLOAT::DOUBLE, 4) AS ch0", f"SELECT *, sqrt((pow(2 * ch0 - 255, 2) + pow(2 * ch1 - 255, 2) + pow(2 * ch2 - 255, 2)) / 3) AS p, sqrt((ch0 * ch0 + ch1 * ch1 + ch2 * ch2) / 3.0) AS q FROM ({BASE})", 4)
matrix("matrix_hsv_back", lambda m: V.merge_colours(V.split_colours(m, "HSV"), "HSV"), each("$"))
matrix("matrix_hls_back", lambda m: V.merge_colours(V.split_colours(m, "HLS"), "HLS"), each("$"))
matrix("matrix_lightness", lambda m: V.split_colours(m, "HLS")[1], "round(((greatest(ch0, ch1, ch2) + least(ch0, ch1, ch2)) / 510.0)::FLOAT::DOUBLE, 5) AS ch0")
matrix("matrix_value", lambda m: V.split_colours(m, "HSV")[2], "round((greatest(ch0, ch1, ch2) / 255.0)::FLOAT::DOUBLE, 5) AS ch0")
matrix("matrix_grey", lambda m: M.with_channels(m, 1), "floor(0.299::DOUBLE * ch0 + 0.587::DOUBLE * ch1 + 0.114::DOUBLE * ch2 + 0.5)::DOUBLE AS ch0")
matrix("matrix_four_channels", lambda m: M.with_channels(m, 4), each("$") + ", 255::DOUBLE AS ch3")
matrix("matrix_raw_cast", lambda m: M.precision(m, "float", True), each("$"))
matrix("matrix_contrast", lambda m: V.contrast(m.of([F.col("ch0")]), 0.0, 1.0), "floor(ch0 * 255.0 / (SELECT max((x * 6) % 256) FROM range(40) r(x)) + 0.5)::DOUBLE AS ch0")
matrix("matrix_contrast_shares", lambda m: V.contrast(m.of([F.col("ch1")]), 0.25, 0.75, "VALUE_BETWEEN_MIN_AND_MAX", "ABSOLUTE_VALUE"), "floor(least(greatest((ch1 - 0.25 * 232) * 255 / (0.75 * 255 - 0.25 * 232), 0), 255) + 0.5)::DOUBLE AS ch0")
matrix("matrix_contrast_colours", lambda m: V.contrast(M.precision(m, "float", True).map(lambda c: c / 255.0), 0.2, 0.6, "ABSOLUTE_VALUE", "ABSOLUTE_VALUE"),
       ", ".join(f"round((CASE WHEN g = 0 THEN 0 ELSE least(c{k} * least(greatest((g - 0.2::DOUBLE) / (0.6::DOUBLE - 0.2::DOUBLE), 0), 1) / g, 1) END)::FLOAT::DOUBLE, 4) AS ch{k}" for k in range(3)),
       f"SELECT *, 0.299::DOUBLE * c0 + 0.587::DOUBLE * c1 + 0.114::DOUBLE * c2 AS g FROM (SELECT x, y, (ch0 / 255.0::DOUBLE)::FLOAT::DOUBLE AS c0, (ch1 / 255.0::DOUBLE)::FLOAT::DOUBLE AS c1, (ch2 / 255.0::DOUBLE)::FLOAT::DOUBLE AS c2 FROM ({BASE}))", 4)
matrix("matrix_percent_size", lambda m: M.resized(m, 50, None, percents=True), each("floor($ + 0.5)"), f"SELECT x // 2 AS x, y // 2 AS y, avg(ch0) AS ch0, avg(ch1) AS ch1, avg(ch2) AS ch2 FROM ({BASE}) GROUP BY 1, 2")
matrix("matrix_layer", lambda m: M.layer(M.interpolated(m.of([F.col("ch0")], "float"), m.of([F.col("ch1")], "float"), 3), -2), "round((ch0 * 0.5 + ch1 * 0.5)::FLOAT::DOUBLE, 5) AS ch0")
matrix("matrix_flattened", lambda m: M.flattened(M.interpolated(m.of([F.col("ch0")], "float"), m.of([F.col("ch1")], "float"), 2)), "round(v::FLOAT::DOUBLE, 5) AS ch0", f"SELECT x, y, ch0 AS v FROM ({BASE}) UNION ALL SELECT x, y + {H}, ch1 FROM ({BASE})")
matrix("matrix_switch", lambda m: flow.switch(2, [m, lambda: M.inverted(m)]), each("255 - $"))
matrix("matrix_double_size", lambda m: M.resized(m, 2 * W, 2 * H, "NEAREST"), each("$"), f"SELECT 2 * x + a AS x, 2 * y + b AS y, ch0, ch1, ch2 FROM ({BASE}), range(2) p(a), range(2) q(b)")
for _mode, _pick in (("AVERAGING_MIN", "min"), ("AVERAGING_MAX", "max")):
    matrix(f"matrix_{_mode.lower()}", lambda m, mode=_mode: M.resized(m, W // 2, H // 2, mode), each("$"), f"SELECT x // 2 AS x, y // 2 AS y, {_pick}(ch0) AS ch0, {_pick}(ch1) AS ch1, {_pick}(ch2) AS ch2 FROM ({BASE}) GROUP BY 1, 2")
matrix("matrix_bilinear_half", lambda m: M.resized(M.precision(m, "float", True), W // 2, H // 2, "AVERAGING_BILINEAR"), each("$"), f"SELECT x // 2 AS x, y // 2 AS y, avg(ch0) AS ch0, avg(ch1) AS ch1, avg(ch2) AS ch2 FROM ({BASE}) GROUP BY 1, 2")
_near = "CASE WHEN {c} % 2 = 0 THEN greatest({c} // 2 - 1, 0) ELSE least({c} // 2 + 1, {n} - 1) END"
matrix(
    "matrix_bilinear_double", lambda m: M.resized(m.of([F.col("ch0")], "float"), 2 * W, H, "BILINEAR"), "round((0.75 * a + 0.25 * b)::FLOAT::DOUBLE, 5) AS ch0",
    f"SELECT x::INT AS x, y::INT AS y, ((x // 2) * 6) % 256 AS a, ({_near.format(c='x', n=W)} * 6) % 256 AS b FROM range({2 * W}) p(x), range({H}) q(y)",
)


@query("matrix_difference_info", f"SELECT 0 AS channel, round(avg(abs(2 * ch0 - 255)), 6) AS mean, max(abs(2 * ch0 - 255))::DOUBLE AS max FROM ({BASE})")
def matrix_difference_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the difference of a matrix and its inverse."""
    m = base(spark).of([F.col("ch0")], "float")
    rest = base(spark).of([255 - F.col("ch0")], "float")
    return V.difference_info(m, rest).select("channel", F.round("mean", 6).alias("mean"), "max")


@query("image_statistics", f"""WITH v AS (SELECT 0 AS channel, ch0 AS v FROM ({BASE}) WHERE x > 9 UNION ALL SELECT 1, ch1 FROM ({BASE}) WHERE x > 9), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM v),
    p AS (SELECT channel, max(CASE WHEN k = floor(0.1 * n) THEN v END) AS a, max(CASE WHEN k = floor(0.9 * n) THEN v END) AS b FROM r GROUP BY channel)
    SELECT channel, a::DOUBLE AS percentile_1, b::DOUBLE AS percentile_2, count(*) AS number_of_checked_pixels, round(avg(v), 6) AS mean, round(avg(CASE WHEN v BETWEEN a AND b THEN v END), 6) AS between_limits FROM r JOIN p USING (channel) GROUP BY channel, a, b""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and means by channel under a mask."""
    m = base(spark)
    found = V.image_statistics(m.of([F.col("ch0"), F.col("ch1")]), m.of([F.col("x") > 9], "boolean"))
    return found.select("channel", "percentile_1", "percentile_2", "number_of_checked_pixels", F.round("mean", 6).alias("mean"), F.round("mean_between_percentiles", 6).alias("between_limits"))


@query("image_histogram", f"""SELECT 'uniform' AS kind, c AS channel, g AS bin, count(v) AS n FROM range(2) t(c), range(256) u(g) LEFT JOIN (SELECT 0 AS channel, ch0 AS v FROM ({BASE}) UNION ALL SELECT 1, ch1 FROM ({BASE})) ON channel = c AND v = g GROUP BY 1, 2, 3
    UNION ALL SELECT 'range', c, g, count(v) FROM range(2) t(c), range(4) u(g) LEFT JOIN (SELECT 0 AS channel, ch0 AS v, 234.0 AS top FROM ({BASE}) UNION ALL SELECT 1, ch1, 232.0 FROM ({BASE})) ON channel = c AND least(floor(v / (top / 4)), 3) = g GROUP BY 1, 2, 3""")
def image_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of two channels over the whole range and over least to largest."""
    m = base(spark).of([F.col("ch0"), F.col("ch1")])
    every = V.image_histogram(m).select(F.lit("uniform").alias("kind"), "channel", "bin", "n")
    return every.union(V.image_histogram(m, None, 4, "RANGE_BASED").select(F.lit("range"), "channel", "bin", "n"))


@query("matrix_box_text", "SELECT '6 12\n6 12' AS text")
def matrix_box_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a box of a matrix."""
    m = base(spark)
    return literal(spark, text=constants.print_sub_matrix(m.of([F.col("ch0")]), (1, 1), (2, 2)))


# drawing

WHITE = lambda where: ", ".join(f"CASE WHEN {where} THEN 255 ELSE ch{k} END::DOUBLE AS ch{k}" for k in range(3))
matrix("draw_rectangle", lambda m: drawing.rectangle(m, 3, 4, 10, 12, 2), WHITE("x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 15 AND NOT (x BETWEEN 5 AND 10 AND y BETWEEN 6 AND 13)"))
matrix("draw_ellipse", lambda m: drawing.ellipse(m, 20, 15, 20, 10, 0), WHITE("pow((x - 20) / 10.0, 2) + pow((y - 15) / 5.0, 2) <= 1"))
matrix("draw_line", lambda m: drawing.line(m, 5, 10, 25, 10, 3), WHITE("pow(x - least(greatest(x, 5), 25), 2) + pow(y - 10, 2) <= 2.25"))
matrix("draw_straight", lambda m: drawing.straight(m, 8, 0, 90.0, 3), WHITE("abs(x - 8) <= 1.5"))
matrix("draw_arrow", lambda m: drawing.arrow(m, 5, 15, 30, 15, 1, 10, 5), WHITE("(pow(x - least(greatest(x, 5), 30), 2) + pow(y - 15, 2) <= 0.25) OR (30 - x BETWEEN 0 AND 10 AND abs(y - 15) <= (30 - x) * 0.5)"))
matrix("draw_image", lambda m: drawing.overlay(m, M.cropped(M.inverted(m), 0, 0, 10, 8), 4, 5), ", ".join(f"CASE WHEN hit IS NOT NULL THEN t{k} ELSE ch{k} END::DOUBLE AS ch{k}" for k in range(3)),
       f"SELECT a.*, hit, t0, t1, t2 FROM ({BASE}) a LEFT JOIN (SELECT x + 4 AS x, y + 5 AS y, 1 AS hit, 255 - ch0 AS t0, 255 - ch1 AS t1, 255 - ch2 AS t2 FROM ({BASE}) WHERE x < 10 AND y < 8) b ON a.x = b.x AND a.y = b.y")

# chains


def chain_block(name: str, executor: str, parameters: dict | None = None, inputs=(), outputs=("output",), feeds=(), **more) -> dict:
    """A block of a chain file whose ports are named by the block and the port."""
    ports = [{"uuid": f"to {name}.{p}", "type": 1, "name": p} for p in inputs] + [{"uuid": f"{name}.{p}", "type": 2, "name": p} for p in outputs]
    ports += [{"uuid": f"to {name}.@{p}", "type": 3, "name": p} for p in feeds]
    shown_name = more.pop("shown", name)
    return {"uuid": name, "executor_name": executor, "system": {"name": shown_name}, "parameters": [{"name": k, "value": v} for k, v in (parameters or {}).items()], "ports": ports, **more}


def chain_text(blocks: list[dict], links: list[tuple[str, str]], **head) -> str:
    """Text of a chain file."""
    execution = {k: head.pop(k) for k in ("all", "ignore_exceptions") if k in head}
    return json.dumps({"chain": {"executor": {**head, "options": {"execution": execution}}, "blocks": blocks, "links": [{"src_port_uuid": a, "dest_port_uuid": f"to {b}"} for a, b in links]}})


#: The factorial of n by a chain that calls itself, as the demonstration chain describes it.
FACTORIAL = chain_text(
    [
        chain_block("n", "Scalar integer parameter", {"value": 10}), chain_block("compare", "Compare 2 numbers (=, ≠, <, ≤, >, ≥)", {"defaultY": 1.0}, ["x"], ["less", "greater"]),
        chain_block("check", "if (xxx) throw an exception", {"message": "Zero or negative n="}, ["if", "s"], ["s"]), chain_block("less", "Scalar ax + by + Δ", {"a": 1.0, "summand": -1.0, "roundingMode": "CAST_TO_LONG"}, ["x"]),
        chain_block("self", "recursive_factorial", {"n": 9}, feeds=["n"], executor_id="factorial-id"), chain_block("times", "Scalar m * x^a * y^b", {"a": "1.0", "b": "1.0", "m": 1.0}, ["x", "y"]),
        chain_block("round", "Round scalar (single number)", {"roundingMode": "ROUND_TO_LONG"}, ["input"]), chain_block("if", "if (xxx)... (for scalar)", {"defaultFalse": "1"}, ["if", "true", "false"]),
        chain_block("out", "Output/copy scalar", inputs=["input"], shown=""),
    ],
    [("n.output", "compare.x"), ("compare.less", "check.if"), ("compare.greater", "check.s"), ("check.s", "if.if"), ("n.output", "less.x"), ("less.output", "self.@n"), ("n.output", "times.x"), ("self.output", "times.y"), ("times.output", "round.input"), ("round.output", "if.true"), ("if.output", "out.input")],
    id="factorial-id",
)


@query("chain_factorial", "SELECT 3628800.0 AS ten, 1.0 AS one, true AS refused")
def chain_factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain that calls itself."""
    run = lambda n: float(chains.Chain.read(FACTORIAL).run(chains.scalar_registry(), parameters={"n": n})["output"])
    try:
        run(0)
        refused = False
    except ValueError:
        refused = True
    return literal(spark, ten=run(10), one=run(1), refused=refused)


def product_chain() -> chains.Chain:
    """m x^a y^b of two inputs with parameters a and b."""
    return chains.Chain.read(
        chain_text(
            [chain_block("x", "Input/create double scalar", {"value": 20.0}), chain_block("y", "Input/create double scalar", {"value": 10.0}), chain_block("a", "Scalar double parameter", {"value": 2.0}), chain_block("b", "Scalar double parameter", {"value": 1.0}),
             chain_block("power", "Scalar m * x^a * y^b", {"m": 1.0}, ["x", "y"], feeds=["a", "b"]), chain_block("print", "Print scalar", {"pattern": "Result: $$$"}, ["input", "s"], ["s"]), chain_block("out", "Output/copy scalar", inputs=["input"], shown="")],
            [("x.output", "power.x"), ("y.output", "power.y"), ("a.output", "power.@a"), ("b.output", "power.@b"), ("power.output", "print.s"), ("power.output", "print.input"), ("print.s", "out.input")],
        )
    )


def sum_chain() -> chains.Chain:
    """a x + b y of two inputs with parameters a and b."""
    return chains.Chain.read(
        chain_text(
            [chain_block("x", "Input/create double scalar", {"value": 20.0}), chain_block("y", "Input/create double scalar", {"value": 10.0}), chain_block("a", "Scalar double parameter", {"value": 0.1}), chain_block("b", "Scalar double parameter", {"value": 0.1}),
             chain_block("sum", "Scalar ax + by + Δ", {"summand": 0.0}, ["x", "y"], feeds=["a", "b"]), chain_block("out", "Output/copy scalar", inputs=["input"], shown="")],
            [("x.output", "sum.x"), ("y.output", "sum.y"), ("a.output", "sum.@a"), ("b.output", "sum.@b"), ("sum.output", "out.input")],
        )
    )


@query("chain_scalar_product", "SELECT 4000.0 AS output, 90.0 AS given")
def chain_scalar_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain by its defaults, and with inputs and parameters."""
    run = lambda *a: float(product_chain().run(chains.scalar_registry(), *a)["output"])
    return literal(spark, output=run(), given=run({"x": 3, "y": 10}, {"a": "2", "b": "1"}))


@query("multi_chain", "SELECT 3.0 AS standard, 4000.0 AS chosen, 110.0 AS overridden")
def multi_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a family of chains, chosen and overridden by settings."""
    family = chains.MultiChain({"scalar_sum": sum_chain(), "scalar_product": product_chain()}, "scalar_sum")
    run = lambda s, name="": float(family.run(chains.scalar_registry(), {"x": 20.0, "y": 10.0}, s, name)["output"])
    overridden = {"a": 7.0, "@multi_scalar": {"___selectedChainName": "scalar_sum", "a": 3.0, "b": 5.0}}
    return literal(spark, standard=run({}), chosen=run({"___selectedChainName": "scalar_product"}), overridden=run(overridden, "multi_scalar"))


@query("chain_of_arrays", f"{EV}round(v, 6) AS value FROM (SELECT event_id, 2 * value + (-value)::FLOAT::DOUBLE + 3 AS v FROM events) WHERE v BETWEEN 40 AND 90")
def chain_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators on a table's array as blocks: negated, combined, kept by a range."""
    text = chain_text(
        [chain_block("x", "Input/numbers"), chain_block("neg", "NumbersNegate", inputs=["input"]), chain_block("sum", "LinearCombinationOfTwoNumbers", {"a": 2.0, "b": 1.0, "summand": 3.0}, ["x", "y"]),
         chain_block("kept", "ExtractNumbersInRange", {"min": 40.0, "max": 90.0}, ["input"]), chain_block("out", "Output/copy numbers", inputs=["input"], shown="")],
        [("x.output", "neg.input"), ("x.output", "sum.x"), ("neg.output", "sum.y"), ("sum.output", "kept.input"), ("kept.output", "out.input")],
    )
    return shown(chains.Chain.read(text).run(chains.scalar_registry(), {"x": values(spark, sf_dir).slice(0, 1)})["output"])


@query("chain_of_matrices", f"SELECT x, y, {each('(2 * ($ / 255.0::DOUBLE)::FLOAT::DOUBLE - 1)::FLOAT::DOUBLE')} FROM ({BASE})")
def chain_of_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture in a chain: to float, then 2 v - 1 by parameters."""
    text = chain_text(
        [chain_block("a", "Scalar double parameter", {"value": 2.0}), chain_block("b", "Scalar double parameter", {"value": -1.0}), chain_block("in", "Input/read image", shown=""), chain_block("float", "Change precision", {"elementType": "float", "rawCast": False}, ["input"]),
         chain_block("linear", "Linear function (elementwise): a₁x₁ + a₂x₂ + ... + b", {"a_1": 1.0, "a_2": 1.0, "b": 0.0, "elementType": "unchanged"}, ["input_1"], feeds=["a_1", "b"]), chain_block("out", "Output/copy matrix", inputs=["input"], shown="")],
        [("in.output", "float.input"), ("float.output", "linear.input_1"), ("a.output", "linear.@a_1"), ("b.output", "linear.@b"), ("linear.output", "out.input")],
    )
    m = chains.Chain.read(text).run(chains.scalar_registry(), {"input": base(spark)})["output"]
    return m.df.select("x", "y", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in m.names])


@query("chain_loop", "SELECT '5' AS rounds, 'kept' AS ignored")
def chain_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a chain until a condition ends, and a failure that is ignored."""
    loop = chain_text(
        [chain_block("count", "IterationCount", outputs=["count"]), chain_block("less", "CompareTwoNumbers", {"defaultY": 4.0}, ["x"], ["less"]), chain_block("loop", "RepeatWhile", inputs=["while"], outputs=["count_1"]), chain_block("out", "Output/copy scalar", inputs=["input"], shown="")],
        [("count.count", "less.x"), ("less.less", "loop.while"), ("loop.count_1", "out.input")],
    )
    failing = chain_text(
        [chain_block("bad", "ThrowException", {"message": "no"}, ["if"]), chain_block("yes", "CreateBoolean", {"value": True}), chain_block("out", "Output/copy scalar", {"value": "kept"}, ["input"], shown="")],
        [("yes.output", "bad.if"), ("bad.output", "out.input")], ignore_exceptions=True,
    )
    run = lambda text: chains.Chain.read(text).run(chains.scalar_registry())["output"]
    return literal(spark, rounds=run(loop), ignored=run(failing))
