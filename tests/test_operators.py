"""Operators beyond the catalogue: empty inputs, NaN, ties, files, flow, chains, settings, streams."""

import json

import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.model import Numbers, grid, literal_array
from fluxgrid.operators import arithmetic as A
from fluxgrid.operators import flow
from fluxgrid.operators import lookups as L
from fluxgrid.operators import matrices as M
from fluxgrid.operators import shapes as P
from fluxgrid.operators import statistics as T
from fluxgrid.plans import chains, formulas, settings
from fluxgrid.sources import files
from fluxgrid.streaming import folders


def rows(x: Numbers):
    return [tuple(r)[1:] for r in x.df.orderBy("_i").collect()]


def test_casts_saturate_and_truncate(spark):
    x = literal_array(spark, [[300.7, -1.0, float("nan")]])
    assert rows(x.cast("byte")) == [(255, 0, 0)]
    assert rows(literal_array(spark, [[1e30, -1e30]]).cast("long")) == [((1 << 63) - 1, -(1 << 63))]


def test_comparisons_with_nan_are_false(spark):
    x = literal_array(spark, [[float("nan")], [1.0]])
    assert rows(A.in_range(x, 0, 2)) == [(0.0,), (1.0,)]
    assert rows(A.equality(x, x)) == [(0.0,), (1.0,)]
    assert rows(A.logarithm(literal_array(spark, [[0.0]]))) == [(float("-inf"),)]


def test_zip_of_different_frames(spark):
    x, y = literal_array(spark, [[1.0], [2.0]]), literal_array(spark, [[10.0], [20.0]])
    assert rows(A.linear(x, y, 1, 2, 3)) == [(24.0,), (45.0,)]
    assert rows(P.merge_columns([x, None, y])) == [(1.0, 10.0), (2.0, 20.0)]
    assert rows(P.merge_rows([x, y])) == [(1.0,), (2.0,), (10.0,), (20.0,)]


def test_empty_arrays(spark):
    empty = literal_array(spark, [])
    assert A.check_in_range(empty, 0, 1)
    assert T.info(empty).first()["n"] == 0
    assert rows(P.extract(empty, 0, 5)) == []


def test_sort_reverses_ties_when_descending(spark):
    x = literal_array(spark, [[1.0, 0.0], [2.0, 1.0], [1.0, 2.0], [2.0, 3.0]])
    up, places, back = L.sort(x)
    assert [r[1] for r in rows(up)] == [0.0, 2.0, 1.0, 3.0]
    assert [r[0] for r in rows(places)] == [1, 3, 2, 4]
    assert [r[0] for r in rows(back)] == [1, 3, 2, 4]
    down = L.sort(x, descending=True)[0]
    assert [r[1] for r in rows(down)] == [3.0, 1.0, 2.0, 0.0]


def test_nearest_centre_takes_the_last_of_equal_ones(spark):
    found = L.nearest_centres(literal_array(spark, [[0.0], [9.0]]), literal_array(spark, [[1.0], [-1.0]]), max_distance=5)
    assert rows(found) == [(2, 1.0), (-1, float("inf"))]


def test_invert_table_keeps_the_first(spark):
    assert rows(L.invert_table(literal_array(spark, [[3], [1], [3]], "int"))) == [(2,), (-1,), (1,)]


def test_check_equal_raises(spark):
    with pytest.raises(AssertionError):
        A.check_equal(literal_array(spark, [[1.0]]), literal_array(spark, [[2.0]]))
    assert A.check_equal(None, None)


def test_truth_of_texts(spark):
    cases = {"1": (True, True, False), "0.00": (False, False, False), "false": (False, True, False), "TRUE": (True, True, True), "": (False, False, False), " ": (True, True, False)}
    for text, (common, c_like, java) in cases.items():
        row = spark.range(1).select(*[S.truth(F.lit(text), s).alias(s) for s in ("COMMON", "C_LIKE", "JAVA_LIKE")]).first()
        assert tuple(row) == (common, c_like, java), text
        assert tuple(flow.truth(text, s) for s in ("COMMON", "C_LIKE", "JAVA_LIKE")) == (common, c_like, java), text


def test_flow_asks_for_the_chosen_branch_only():
    def never():
        raise AssertionError

    assert flow.choose("true", lambda: 1, never) == 1
    assert flow.switch(0, [None, lambda: 2, never]) == 2
    assert flow.redirect("x", 2, 3) == [None, "x", None]
    assert flow.Loop(most=5).run(lambda k: "true") == 5
    assert flow.Loop().run(lambda k: "true" if k < 3 else "false") == 4
    with pytest.raises(IndexError):
        flow.throw_if("true", "INDEX_OUT_OF_BOUNDS_EXCEPTION")


def test_formula_refuses_statements(spark):
    with pytest.raises(ValueError):
        formulas.compiled("__import__('os')", {})


def block(uuid, name, ports, own="", **parameters):
    return {
        "uuid": uuid, "executor_name": name, "system": {"name": own}, "executor_id": parameters.pop("id", ""),
        "parameters": [{"name": k, "value": v} for k, v in parameters.items()],
        "ports": [{"uuid": f"{uuid}.{p}", "type": t, "name": p} for p, t in ports.items()],
    }


def chain(blocks, links, own=""):
    return chains.Chain.read(json.dumps({"chain": {"executor": {"id": own}, "blocks": blocks, "links": [{"src_port_uuid": a, "dest_port_uuid": b} for a, b in links]}}))


def test_chain_feeds_parameters_by_links_and_overrides_inputs():
    c = chain(
        [
            block("x", "Input/create double scalar", {"output": 2}, "x", value=20.0),
            block("a", "Parameter double", {"output": 2}, "a", value=0.1),
            block("s", "Scalar ax + by + Δ", {"x": 1, "a": 3, "output": 2}, a=5.0),
            block("o", "Output scalar", {"input": 1}, "result"),
        ],
        [("x.output", "s.x"), ("a.output", "s.a"), ("s.output", "o.input")],
    )
    r = chains.scalar_registry()
    assert c.run(r) == {"result": 2.0}
    assert c.run(r, {"x": 7.0}, {"a": 3}) == {"result": 21.0}
    family = chains.MultiChain({"one": c, "two": c}, "one")
    assert family.run(r, {"x": 1.0}, {"@f": {"___selectedChainName": "two", "a": 4}}, "f") == {"result": 4.0}


def test_chain_calls_itself():
    c = chain(
        [
            block("n", "Parameter double", {"output": 2}, "n", value=1),
            block("c", "Compare 2 numbers (=, ≠, <, ≤, >, ≥)", {"x": 1, "greater": 2}, defaultY=1),
            block("m", "Scalar ax + by + Δ", {"x": 1, "output": 2}, summand=-1),
            block("self", "again", {"n": 3, "result": 2}, id="F"),
            block("p", "Scalar m * x^a * y^b", {"x": 1, "y": 1, "output": 2}),
            block("i", "if (xxx)... (for scalar)", {"if": 1, "true": 1, "output": 2}, defaultFalse="1"),
            block("o", "Output scalar", {"input": 1}, "result"),
        ],
        [
            ("n.output", "c.x"), ("n.output", "m.x"), ("m.output", "self.n"), ("n.output", "p.x"), ("self.result", "p.y"),
            ("c.greater", "i.if"), ("p.output", "i.true"), ("i.output", "o.input"),
        ],
        "F",
    )
    assert float(c.run(chains.scalar_registry(), parameters={"n": 10})["result"]) == 3628800


def test_settings_and_mappings():
    s = settings.Settings("s", [{"name": "a", "kind": "double", "default": 1.0}, {"name": "sub", "kind": "settings", "default": {}}])
    record = s.combine({"a": "2"}, {"@sub": {"k": 1}})
    assert record == {"a": 2.0, "@sub": {"k": 1}} and s.split(record) == {"a": 2.0, "sub": {"k": 1}}
    assert settings.sub(record, "sub", "OVERRIDE_PARENT") == {"a": 2.0, "k": 1}
    assert settings.with_sub(record, "sub", {"k": 2, "z": 3}, "ADD_NEW")["@sub"] == {"k": 1, "z": 3}
    keys = settings.mapping_keys("RED // red\nGREEN\nBLUE\n0\n1..30 // number $$$")
    assert len(keys) == 34 and keys[0] == ("RED", "red") and keys[-1] == ("30", "number 30")


def test_csv_round_trip(spark, tmp_path):
    x = literal_array(spark, [[1.5, 2.0], [3.0, -4.25], [5.0, 6.0]])
    files.write_csv(x, str(tmp_path / "out"), ["a", "b"])
    (tmp_path / "in.csv").write_text("float_1;float_2\r\n1.5;2\r\n3 -4.25\r\n5\r\n")
    found, header = files.read_csv(spark, str(tmp_path / "in.csv"))
    assert header == ["float_1", "float_2"] and rows(found) == [(1.5, 2.0), (3.0, -4.25), (5.0, 0.0)]
    assert sorted(r.a for r in spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()) == [1.5, 3.0, 5.0]


def test_csv_of_many_files(spark, tmp_path):
    """Every file that write_csv leaves has a header, which is no row."""
    n = 400
    x = Numbers(spark.range(n).selectExpr("id AS _i", "id / 4 AS a", "-id * 1.5D AS b").repartition(3), ("a", "b"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        files.write_csv(x, str(tmp_path / "out"), ["price", "size"])
        assert len(list((tmp_path / "out").glob("part-*"))) > 1
        for size, cost in (("128m", "4m"), ("1k", "0"), ("50", "0")):  # splits of whole files, of parts and of a few lines
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            found, header = files.read_csv(spark, str(tmp_path / "out"), "double")
            assert header == ["price", "size"] and rows(found) == [(k / 4, -k * 1.5) for k in range(n)]
            assert [r[0] for r in found.df.select("_i").orderBy("_i").collect()] == list(range(n))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_csv_files_with_and_without_headers(spark, tmp_path):
    """The first file in the order of paths, not the longest, gives the width; skipped lines are those of each file."""
    texts = {"a": "note\nu v;w\n", "b c": "\n\nnote\n\n1 2\n3,4,5,6\n", "d": "", "e": "note\np,q\n" + "7 8 9\n" * 20, "f": "note\n", "g": "note\n1e3,x\n0 0 1\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    found, header = files.read_csv(spark, str(tmp_path), "double", skipped=1)
    assert header == ["u", "v", "w"]
    assert [tuple(r) for r in found.df.orderBy("_i").collect()] == [
        (k, *r) for k, r in enumerate([(1.0, 2.0, 0.0), (3.0, 4.0, 5.0), *[(7.0, 8.0, 9.0)] * 20, (0.0, 0.0, 1.0)])
    ]
    (tmp_path / "bom").mkdir()
    (tmp_path / "bom" / "x.csv").write_bytes(b"\xef\xbb\xbf1;2\n3;4\n")
    found, header = files.read_csv(spark, str(tmp_path / "bom" / "x.csv"))
    assert header == [] and rows(found) == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "x.csv").write_text("\n \n")
    assert files.read_csv(spark, str(tmp_path / "blank"))[0].df.count() == 0


def test_raw_files_go_on_in_the_order_of_paths(spark, tmp_path):
    import numpy as np

    np.arange(4, dtype=">f4").tofile(tmp_path / "a.dat")
    np.arange(4, 8, dtype=">f4").tofile(tmp_path / "b.dat")
    found = files.read_raw(spark, str(tmp_path), 2, "float", "big", "*.dat")
    assert rows(found) == [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0), (6.0, 7.0)]


def test_scalars_in_folder_and_as_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    found = files.scalars_in_folder(spark, str(tmp_path)).orderBy("file_index").collect()
    assert [(r.text, r.file_index, r.number_of_files) for r in found] == [(f"text {k}", k, 3) for k in range(3)]
    folders.drained(folders.text_files(spark, str(tmp_path)), "folder_texts")
    assert sorted(r.text for r in spark.table("folder_texts").collect()) == ["text 0", "text 1", "text 2"]
    assert files.read_scalar(spark, str(tmp_path / "none.txt"), "default") == "default"


def test_paths():
    assert files.resolved_path("my/${file.name.ext}", "/a/b/c.txt") == "my/c.txt"
    assert files.resolved_path("a${something}") == "a${something}"
    with pytest.raises(ValueError):
        files.resolved_path("%TEMP%/x", secure=True)


def test_matrix_colours_and_hue(spark):
    assert M.colour("#FF0080")[0] == 1 and M.colour("(0.5,1,1)") == [0.5, 1.0, 1.0] and M.colour("[255,0,51]") == [1.0, 0.0, 0.2]
    m = grid(spark, 1, 1, [F.lit(255), F.lit(0), F.lit(0)])
    assert tuple(M.split_hsv(m).df.first())[2:] == (0.0, 1.0, 1.0)
    assert tuple(M.with_channels(m, 4).df.first())[2:] == (255, 0, 0, 255)
    assert tuple(M.with_channels(m, 1).df.first())[2:] == (76,)
