"""Constants, scripts, system information and stored matrices."""

import json

import pytest
from pyspark.sql import functions as F

from fluxgrid.model import grid, literal_array
from fluxgrid.operators import constants
from fluxgrid.plans import scripts, settings, system
from fluxgrid.sources import folders


def rows(x):
    return [tuple(r)[1:] for r in x.df.orderBy("_i").collect()]


def test_constants(tmp_path, capsys):
    assert constants.create_double(3.0) == "3" and constants.create_double(2.5) == "2.5" and constants.create_boolean(True, style="C_LIKE") == "1"
    assert constants.create_integer(7, "8") == "8" and json.loads(constants.copy_json('{"a":1}')) == {"a": 1}
    assert constants.print_scalar("x", "<$$$>") == "x" and capsys.readouterr().out == "<x>\n"
    constants.write_scalar("text", str(tmp_path / "a"))
    assert (tmp_path / "a").read_text() == "text"
    constants.write_scalar("", str(tmp_path / "a"), delete_if_empty=True)
    assert not (tmp_path / "a").exists()
    assert constants.copy_if_requested({"a": 1, "b": 2}, {"a": "true"}) == {"a": 1}


def test_assignments(spark):
    x = literal_array(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert rows(scripts.modify_named(x, ["a", "b"], "a = b * p; x1 += a", p=10)) == [(20.0, 22.0), (40.0, 44.0)]
    out = scripts.modify_several({"a": x, "b": x}, "a[0] = a[0] * p + k; b[1] = a[0]", p=2)
    assert rows(out["a"]) == [(2.0, 2.0), (7.0, 4.0)] and rows(out["b"]) == [(1.0, 2.0), (3.0, 7.0)]
    with pytest.raises(ValueError):
        scripts.modify_named(x, ["a", "b"], "while (a > 0) a -= 1")


def test_scalar_formula_and_loop(spark):
    assert scripts.scalar_formula(spark, "a > 1 ? a * b : 0", a="3", b=4) == 12
    assert scripts.repeat({"a": 1}, "a *= 2", "a < 100") == {"a": 128, "i": 7}
    assert scripts.repeat({"a": 1}, "a += 1", "a < 100", 5)["a"] == 6
    with pytest.raises(ValueError):
        scripts.repeat({"a": 1}, "a = a.real", "a < 100")


def test_scripts_over_rows(spark):
    """Branches, returns, unrolled loops and functions become expressions."""
    x = literal_array(spark, [[1.0, 2.0], [3.0, 4.0], [-5.0, 0.0]])
    text = """
    function clip(v, low, high) { if (v < low) return low; if (v > high) { return high } return v }
    var total = 0
    for (var j = 0; j < 3; j++) { if (j == 1) continue; total += j * b }   // unrolled
    if (a > 0 && b < 4) { a = clip(a * 10, 0, 15); b = total } else if (b === 0) b = -1
    else { a = Math.max(a, b) / 0 }
    """
    found = scripts.modify_named(x, ["a", "b"], text)
    assert rows(found) == [(10.0, 4.0), (float("inf"), 4.0), (-5.0, -1.0)]
    assert "Python" not in found.df._jdf.queryExecution().executedPlan().toString()
    out = scripts.modify_several({"m": x}, "for (let j = 0; j < m.length; j++) { m[j] = m[j] > 2 ? m[j] : k }")
    assert rows(out["m"]) == [(0.0, 0.0), (3.0, 4.0), (2.0, 2.0)]


def test_scripts_on_the_driver(spark):
    text = """
    /* sum, product and a text */
    function fib(n) { return n < 2 ? n : fib(n - 1) + fib(n - 2); }
    function execute(params, inputs, outputs) {
        let list = [];
        for (let k = 0; k < params.n; k++) { if (k % 2) continue; list.push(fib(k)); if (list.length >= 4) break }
        outputs.list = list.join("; ");
        outputs["text"] = inputs.name.toUpperCase() + ": " + 0.5 + " " + (typeof inputs.none);
        let k = 10; do { k-- } while (k > 3);
        outputs.k = k;
        const square = v => v * v;
        return square(3) ** 2 + {a: [1, 2]}.a[1];
    }"""
    found = scripts.use(text, {"n": 20.0}, {"name": "sum"})
    assert found == {"list": "0; 1; 3; 8", "text": "SUM: 0.5 undefined", "k": 3.0, "output": 83.0}
    assert scripts.scalar_formula(spark, "f(a) + name", "function f(v) { return v + 1 }", a="2", name="x") == "3x"
    assert scripts.use("throwing = 1; throwing + 1")["output"] == 2
    for bad in ("throw 'no'", "while (true) { }", "x = ", "1 +* 2", "unknown + 1", "Math.PI = 3", "a ="):
        with pytest.raises(ValueError):
            scripts.use(bad)


def test_python_functions(spark, tmp_path):
    x = literal_array(spark, [[1.0], [2.0]])
    found = scripts.call_by_batches(x, lambda f: f.assign(d=f["c0"] * 2), ["d"], "float")
    assert rows(found) == [(2.0,), (4.0,)]
    (tmp_path / "own.py").write_text("def execute(params, inputs, outputs):\n    outputs['s'] = 1\n    return params['a'] + inputs['b']\n")
    assert scripts.call(scripts.function_of(str(tmp_path / "own.py")), {"a": 1}, {"b": 2}) == {"s": 1, "output": 3}


def test_system(spark):
    assert system.class_exists("json") and not system.class_exists("no.such.module")
    assert system.log_level("OFF") == ("OFF", False) and system.show_status(spark, "x", "<$$$>") == "<x>"
    assert "spark" in system.system_information(spark)["output"]
    assert system.specification("NumbersAbs")["description"]
    both = {
        "a": settings.Settings("a", [{"name": "b", "kind": "settings", "default": {}}]),
        "b": settings.Settings("b", [{"name": "v", "kind": "int", "default": 1}]),
    }
    assert system.settings_tree(both, "a") == {"@b": {"v": 1}}


def test_matrices_are_stored(spark, tmp_path):
    m = grid(spark, 4, 3, [F.col("x"), F.col("y")])
    folders.write_matrix(m, str(tmp_path / "m"))
    back = folders.read_matrix(spark, str(tmp_path / "m"))
    assert (back.dims, back.channels, back.kind) == ((4, 3), 2, "byte") and back.df.exceptAll(m.df).count() == 0
    assert constants.print_sub_matrix(m, (1, 1), (2, 2)) == "1 2\n1 2\n\n1 1\n2 2"
