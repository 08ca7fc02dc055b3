"""Chains over operators on scalars, arrays and matrices; options, loops, sub-chains."""

import json

import pytest
from pyspark.sql import functions as F

from fluxgrid.model import grid, literal_array
from fluxgrid.plans import blocks, chains
from fluxgrid.plans import rows as chain_rows


def block(name, executor, parameters=None, inputs=(), outputs=("output",), feeds=(), **more):
    """A block whose ports are named by the block and the port."""
    ports = [{"uuid": f"{name}.{p}", "type": 1, "name": p} for p in inputs] + [{"uuid": f"{name}.{p}", "type": 2, "name": p} for p in outputs]
    ports += [{"uuid": f"{name}.@{p}", "type": 3, "name": p} for p in feeds]
    shown = more.pop("shown", name)
    return {"uuid": name, "executor_name": executor, "system": {"name": shown}, "parameters": [{"name": k, "value": v} for k, v in (parameters or {}).items()], "ports": ports, **more}


def chain(blocks_, links, **execution):
    """Text of a chain file."""
    head = {"id": execution.pop("id", "own-id"), "name": execution.pop("name", ""), "options": {"execution": execution}}
    return json.dumps({"chain": {"executor": head, "blocks": blocks_, "links": [{"src_port_uuid": a, "dest_port_uuid": b} for a, b in links]}})


def rows(x):
    return [tuple(r)[1:] for r in x.df.orderBy("_i").collect()]


def test_arrays_in_a_chain(spark):
    text = chain(
        [block("x", "Input/numbers"), block("neg", "NumbersNegate", inputs=["input"]), block("sum", "LinearCombinationOfTwoNumbers", {"a": 2.0, "b": 1.0, "summand": 3.0, "absoluteValue": False}, ["x", "y"]),
         block("kept", "ExtractNumbersInRange", {"min": 4.0, "max": 7.0}, ["input"]), block("most", "MaxNumbers", inputs=["input_1", "input_2"]), block("out", "Output/copy numbers", inputs=["input"], shown="kept"), block("top", "Output/copy numbers", inputs=["input"], shown="top")],
        [("x.output", "neg.input"), ("x.output", "sum.x"), ("neg.output", "sum.y"), ("sum.output", "kept.input"), ("kept.output", "out.input"), ("sum.output", "most.input_1"), ("neg.output", "most.input_2"), ("most.output", "top.input")],
    )
    x = literal_array(spark, [[1.0], [2.0], [-9.0]])
    found = chains.Chain.read(text).run(chains.scalar_registry(), {"x": x})
    assert rows(found["kept"]) == [(4.0,), (5.0,)] and rows(found["top"]) == [(4.0,), (5.0,), (9.0,)]


def test_a_sub_chain_of_matrices(spark, tmp_path):
    """The linear function of a picture with its parameters, registered from a file and called from another chain."""
    inner = chain(
        [block("a", "Scalar double parameter", {"value": 2.0}), block("b", "Scalar double parameter", {"value": -1.0}), block("in", "Input/read image", shown=""), block("float", "Change precision", {"elementType": "float", "rawCast": False}, ["input"]),
         block("linear", "Linear function (elementwise): a₁x₁ + a₂x₂ + ... + b", {"a_1": 1.0, "a_2": 1.0, "b": 0.0, "elementType": "unchanged", "rawValues": False}, ["input_1"], feeds=["a_1", "b"]),
         block("out", "Output/copy matrix", inputs=["input"], shown="")],
        [("in.output", "float.input"), ("float.output", "linear.input_1"), ("a.output", "linear.@a_1"), ("b.output", "linear.@b"), ("linear.output", "out.input")], id="inner-id", name="linear_function",
    )
    (tmp_path / "subchains").mkdir()
    (tmp_path / "subchains" / "linear.chain").write_text(inner, encoding="utf-8")
    outer = chain(
        [block("use", "Use chain(s)", {"file": "subchains/linear.chain"}, execution_stage="loading_time"), block("in", "Input/read image", shown=""), block("a", "Scalar double parameter", {"value": 20.0}),
         block("call", "linear_function", {"a": 2.0, "b": -10.0}, ["input"], feeds=["a"]), block("out", "Output/copy matrix", inputs=["input"], shown="")],
        [("in.output", "call.input"), ("a.output", "call.@a"), ("call.output", "out.input")],
    )
    (tmp_path / "outer.chain").write_text(outer, encoding="utf-8")
    m = grid(spark, 3, 2, [F.col("x") * 85])
    alone = chains.Chain.read(inner).run(chains.scalar_registry(), {"input": m})["output"]
    found = chains.Chain.load(str(tmp_path / "outer.chain")).run(chains.scalar_registry(), {"input": m})["output"]
    for out, a, b in ((alone, 2, -1), (found, 20, -10)):
        assert out.kind == "float" and all(abs(r.ch0 - (a * r.x / 3 + b)) < 1e-5 for r in out.df.collect()) and out.df.count() == 6


def test_failures_can_be_ignored(spark):
    parts = [block("bad", "ThrowException", {"message": "no"}, ["if"]), block("yes", "CreateBoolean", {"value": True}), block("out", "Output/copy scalar", {"value": "kept"}, ["input"])]
    links = [("yes.output", "bad.if"), ("bad.output", "out.input")]
    with pytest.raises(ValueError):
        chains.Chain.read(chain(parts, links)).run(chains.scalar_registry())
    assert chains.Chain.read(chain(parts, links, ignore_exceptions=True)).run(chains.scalar_registry()) == {"out": "kept"}


def test_all_blocks_on_demand(spark, tmp_path):
    target = str(tmp_path / "written")
    parts = [block("text", "CreateScalar", {"value": "hello"}), block("write", "WriteScalar", {"file": target}, ["value"]), block("out", "Output/copy scalar", inputs=["input"])]
    links = [("text.output", "write.value"), ("text.output", "out.input")]
    chains.Chain.read(chain(parts, links)).run(chains.scalar_registry())
    assert not (tmp_path / "written").exists()
    chains.Chain.read(chain(parts, links, all=True)).run(chains.scalar_registry())
    assert (tmp_path / "written").read_text() == "hello"


def test_loops(spark, tmp_path):
    for k in "abc":
        (tmp_path / f"{k}.txt").write_text(k)
    parts = [block("count", "IterationCount", outputs=["count"]), block("less", "CompareTwoNumbers", {"defaultY": 4.0}, ["x"], ["less"]), block("loop", "RepeatWhile", inputs=["while"], outputs=["count_1"]),
             block("file", "FindNextFile", {"file": str(tmp_path), "globPattern": "*.txt"}, outputs=["output", "last"]), block("n", "Output/copy scalar", inputs=["input"]), block("name", "Output/copy scalar", inputs=["input"])]
    links = [("count.count", "less.x"), ("less.less", "loop.while"), ("loop.count_1", "n.input"), ("file.output", "name.input")]
    found = chains.Chain.read(chain(parts, links)).run(chains.scalar_registry())
    assert found["n"] == "5" and found["name"].endswith("b.txt")
    endless = chain([block("loop", "RepeatWhile", inputs=["while"])], [])
    with pytest.raises(ValueError):
        chains.Chain.read(endless).run(chains.scalar_registry())
    three = chain([block("loop", "RepeatWhile", {"maxIterationsCount": 3}, ["while"], ["count"]), block("n", "Output/copy scalar", inputs=["input"])], [("loop.count", "n.input")])
    assert chains.Chain.read(three).run(chains.scalar_registry()) == {"n": "2"}


def test_scalar_operators_as_blocks(spark):
    assert blocks.block("MaxNumber")({}, {"a": "3", "b": "7.5"})["output"] == "7.5"
    assert blocks.block("XorBoolean")({}, {"x": "true", "y": "false"})["output"] == "true"
    assert blocks.block("CompareTwoNumbers")({"booleanStyle": "C_LIKE"}, {"x": "3", "y": "7"})["less"] == "1"
    assert blocks.block("SetJsonValue")({"key": "k", "value": "5"}, {"x": '{"a":1}'})["output"] == '{"a":1,"k":"5"}'
    assert rows(blocks.block("CreateNumbersFromString")({"text": "1 2 3 4", "blockLength": 2}, {})["output"]) == [(1.0, 2.0), (3.0, 4.0)]


def test_specifications_name_blocks(spark, tmp_path):
    spec = {"id": "abc-1", "name": "Negate all", "java": {"class": "some.where.NumbersNegate"}}
    (tmp_path / "negate.json").write_text(json.dumps(spec))
    found = blocks.specified(str(tmp_path))
    x = literal_array(spark, [[1.0]])
    assert rows(found["abc-1"]({}, {"input": x})["output"]) == rows(found["Negate all"]({}, {"input": x})["output"]) == [(-1.0,)]


def test_fixture_like_factorial(spark):
    text = chain_rows.FACTORIAL
    for n, want in ((10, 3628800), (1, 1)):
        assert float(chains.Chain.read(text).run(chains.scalar_registry(), parameters={"n": n})["output"]) == want
    with pytest.raises(ValueError):
        chains.Chain.read(text).run(chains.scalar_registry(), parameters={"n": 0})


def test_script_specifications(tmp_path):
    """Blocks whose functions are in script modules."""
    (tmp_path / "specs").mkdir()
    head = {"id": "js-1", "name": "Sum by script", "language": "js", "js": {"module": "own/sum.mjs"}, "controls": [{"name": "a", "default": 1.0}, {"name": "b", "default": 2.0}]}
    (tmp_path / "specs" / "js.json").write_text(json.dumps(head))
    (tmp_path / "specs" / "py.json").write_text(json.dumps({**head, "id": "py-1", "name": "Sum by Python", "language": "python", "python": {"module": "own.sums"}}))
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "sum.mjs").write_text("export function execute(params, inputs, outputs) {\n outputs.output = parseFloat(params.a) + parseFloat(params.b)\n print(outputs.output)\n return 'Hi'\n}")
    (tmp_path / "own" / "sums.py").write_text("def execute(params, inputs, outputs):\n    outputs.s = inputs.x\n    return params.a + params['b']\n")
    found = blocks.specified(str(tmp_path / "specs"), str(tmp_path))
    assert found["js-1"]({"a": 5.0}, {})["output"] == 7.0 and found["Sum by script"]({}, {})["output"] == 3.0
    assert found["py-1"]({"b": 3.0}, {"x": "text"}) == {"s": "text", "output": 4.0}
