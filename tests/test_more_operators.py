"""Registry, tables, drawing, vectors, folders and images."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid import registry
from fluxgrid.functions import scalars as S
from fluxgrid.model import Numbers, grid, literal_array, numbered
from fluxgrid.operators import arithmetic, drawing, matrices, statistics, tables, vectors
from fluxgrid.operators import matrices as M
from fluxgrid.sources import files, folders


def rows(x):
    return [tuple(r)[1:] for r in x.df.orderBy("_i").collect()]


def pixels(m):
    frame = m.df.toPandas()
    out = np.zeros((m.dims[1], m.dims[0], m.channels))
    out[frame["y"], frame["x"]] = frame[m.names].to_numpy()
    return out


def test_every_operator_is_found():
    assert all(callable(registry.find(n)) for n in registry.OPERATORS)


def test_json_tables(spark):
    t = tables.index_table(spark, '{"a": 5, "1": "big", "4": 2}', '{"a": 0}', '{"big": 9}', least_length=6, filler=-1)
    assert rows(t) == [(5,), (9,), (-1,), (-1,), (2,), (-1,)]
    with pytest.raises(ValueError):
        tables.index_table(spark, '{"0": 1}', base=1)
    assert rows(tables.palette(spark, '{"1": "#FF0000"}', default="(0,0,1)")) == [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]


def test_named_columns_and_text(spark):
    x = literal_array(spark, [[1.0, 2.5], [3.0, 4.0]])
    found = tables.named_columns([(x, ["a", "b"])], ["b", "c"])
    assert [r[0] for r in rows(found)] == [2.5, 4.0] and all(np.isnan(r[1]) for r in rows(found))
    lines = [r.line for r in tables.text_lines(x, line_numbers=True, base=1).orderBy("_i").collect()]
    assert lines == ["1: 1, 2.5", "2: 3, 4"]
    assert tables.array_digest(x).first() == tables.array_digest(literal_array(spark, [[1.0, 2.5], [3.0, 4.0]])).first()
    assert tables.length(x, True).first()[0] == 4
    assert tables.area_scalars(x).first()["max_y"] == 4.0


def test_shapes_are_drawn(spark):
    m = grid(spark, 20, 10, [F.lit(0)])
    frame = pixels(drawing.rectangle(m, 2, 3, 5, 4, 1, "#FFFFFF"))[:, :, 0]
    want = np.zeros((10, 20))
    want[3:7, 2:7] = 255
    want[4:6, 3:6] = 0
    assert (frame == want).all()
    assert pixels(drawing.line(m, 0, 0, 19, 0))[0, :, 0].all() and not pixels(drawing.line(m, 0, 0, 19, 0))[1:].any()
    assert pixels(drawing.straight(m, 0, 5, 0))[5, :, 0].all()
    disk = pixels(drawing.ellipse(m, 10, 5, 6, 6, 0))[:, :, 0]
    assert disk[5, 10] == 255 and disk[5, 13] == 255 and disk[5, 14] == 0
    assert pixels(drawing.arrow(m, 0, 5, 19, 5, length=5, width=2))[5, :, 0].all()
    top = grid(spark, 2, 2, [F.lit(200)])
    assert pixels(drawing.overlay(m, top, 18, 9, 0.5))[9, 19, 0] == 100


def test_vectors_and_colours(spark):
    m = grid(spark, 8, 4, [F.col("x") * 30, F.col("y") * 60, F.lit(10)])
    again = pixels(vectors.from_hsv(M.split_hsv(m)))
    assert np.abs(again - pixels(m)).max() <= 1
    x, y = grid(spark, 1, 1, [F.lit(3.0)], "float"), grid(spark, 1, 1, [F.lit(4.0)], "float")
    a, b = vectors.double_angle(x, y)
    assert abs(pixels(a)[0, 0, 0] + 7 / 5) < 1e-6 and abs(pixels(b)[0, 0, 0] - 24 / 5) < 1e-6
    assert abs(pixels(vectors.angle_difference(x, y, y, x, "SIN"))[0, 0, 0] - 7 / 25) < 1e-6


def test_statistics_under_a_mask(spark):
    m = grid(spark, 10, 10, [F.col("x") * 10 + F.col("y")])
    found = vectors.image_statistics(m, m.of([F.col("x") < 5], "boolean"), 0.1, 0.9).first()
    assert found.number_of_checked_pixels == 50 and found.percentile_1 == 5 and found.percentile_2 == 45 and found.mean == 24.5
    full = pixels(vectors.contrast(m))
    assert full.min() == 0 and full.max() == 255


def test_images_round_trip(spark, tmp_path):
    m = grid(spark, 6, 4, [F.col("x") * 40, F.col("y") * 60, F.lit(7)])
    folders.write_png(m, str(tmp_path / "a.png"))
    back = folders.read_image(spark, str(tmp_path / "a.png"))
    assert back.dims == (6, 4) and (pixels(back) == pixels(m)).all()


def test_folders(tmp_path):
    for name in ("b.txt", "a.dat", "c.tmp", "sub/d.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    root = str(tmp_path / "in")
    assert folders.list_of_files(root, "*.{txt,dat}", recursive=True, absolute=False) == ["a.dat", "b.txt", "sub/d.txt"]
    assert len(folders.copy_or_move(root, str(tmp_path / "out"), "*.{dat,tmp}")) == 2
    assert folders.remove_files(str(tmp_path / "out"), "*.tmp") == 1
    assert folders.existence(root)["is_existing_folder"] == "true"
    steps = folders.FileIterator(folders.list_of_files(root))
    assert [steps.step()["last"] for _ in range(4)] == [False, False, True, False]
    assert folders.changed_extension("a/b.c.txt", "dat") == "a/b.c.dat" and folders.changed_extension("a/b.txt") == "a/b"
    with pytest.raises(ValueError):
        folders.resolve(root, "../other")
    assert folders.resolve(root, "new/deep", operation="CREATE_FOLDER_WITH_PARENTS")["file_name"] == "deep"
    folders.remove_folder(root)
    assert folders.existence(root)["output"] == "0"


def test_resizing_by_axis(spark):
    def axis(new, old, mode):
        """Weights (new, old) of one axis."""
        out = np.zeros((new, old))
        for k in range(new):
            if mode == "BILINEAR" or (mode == "AVERAGING_BILINEAR" and new >= old):
                at = min(max((k + 0.5) * old / new - 0.5, 0), old - 1)
                low = int(at)
                out[k, low] += 1 - (at - low)
                out[k, min(low + 1, old - 1)] += at - low
            elif mode == "AVERAGING_BILINEAR":
                for s in range(old):
                    out[k, s] = max(0, min(s + 1, (k + 1) * old / new) - max(s, k * old / new))
            elif new >= old or mode == "NEAREST":
                out[k, int((k + 0.5) * old / new)] = 1
            else:
                out[k, [s for s in range(old) if s * new // old == k]] = 1
        return out / out.sum(axis=1, keepdims=True)

    m = grid(spark, 6, 5, [F.pmod(F.col("x") * 7 + F.col("y") * F.col("y") * 3, F.lit(11)), F.col("x")], "float")
    old = pixels(m)
    for width, height in ((12, 10), (9, 2), (4, 7), (4, 3), (3, 5), (1, 1), (6, 5)):
        for mode in ("NEAREST", "AVERAGING", "BILINEAR", "AVERAGING_BILINEAR", "AVERAGING_MIN", "AVERAGING_MAX"):
            new = pixels(M.resized(m, width, height, mode))
            x, y = axis(width, 6, mode), axis(height, 5, mode)
            if mode in {"AVERAGING_MIN", "AVERAGING_MAX"}:
                pick = np.min if mode.endswith("MIN") else np.max
                want = np.array([[pick(old[b > 0][:, a > 0], axis=(0, 1)) for a in x] for b in y])
            else:
                want = np.einsum("Yy,Xx,yxc->YXc", y, x, old)
            assert np.allclose(new, want, atol=1e-5), (width, height, mode)
    whole = pixels(M.resized(grid(spark, 2, 1, [F.col("x") * 5]), 4, 1, "BILINEAR"))[0, :, 0]
    assert whole.tolist() == [0, 1, 4, 5]
    with pytest.raises(ValueError):
        M.resized(m, 3, 3, "BICUBIC")


def test_raw_files_round_trip(spark, tmp_path):
    rows = [[1.5, -2.0], [3.25, 4.0], [float("inf"), 0.0]] * 700
    x = literal_array(spark, rows[:300], "double").cast("float")
    for order, mark in (("big", ">"), ("little", "<")):
        folder = str(tmp_path / order)
        assert files.write_raw(x, folder, order, metadata=True, names=["a", "b"], base=1) == 300
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / order).glob("rows-*.raw")))
        assert data == np.array(rows[:300], mark + "f4").tobytes()
        found = files.read_raw(spark, folder, 2, "float", order, glob="*.raw").df.orderBy("_i").collect()
        assert [(r._i, r.c0, r.c1) for r in found] == [(k, *r) for k, r in enumerate(rows[:300])]
        meta = json.loads((tmp_path / f"{order}.meta").read_text())
        assert meta["blockLength"] == 2 and meta["n"] == 300 and meta["elementType"] == "float" and meta["columnIndexes"] == {"a": 1, "b": 2}


def test_json_values_keep_their_types(spark):
    old = '{"a":1,"b":[1,2],"c":true,"d":{"e":null},"f":"x\\"y","g":1.5,"h":null}'
    cases = {
        ("k", "2", "STRING"): {"k": "2"}, ("k", "2", "INTEGER"): {"k": 2}, ("a", " 2.5 ", "DOUBLE"): {"a": 2.5}, ("a", "TRUE", "BOOLEAN"): {"a": True},
        ("b", '{"z":[1]}', "JSON_OBJECT"): {"b": {"z": [1]}}, ("k", "[1,2]", "JSON_ARRAY"): {"k": [1, 2]}, ("c", "", "NULL"): {"c": None}, ('q"r', 'a"b', "STRING"): {'q"r': 'a"b'},
    }
    for (key, value, kind), change in cases.items():
        for text in (old, "{}"):
            frame = spark.createDataFrame([(text,)], "j string")
            new = frame.select(S.json_with(F.col("j"), key, F.lit(value), kind).alias("j")).first().j
            want = {**json.loads(text), **change}
            assert json.loads(new) == want and list(json.loads(new)) == list(want), (key, kind, new)


def test_nan_equals_nothing(spark):
    nan = float("nan")
    x, y = literal_array(spark, [[nan], [1.0], [nan]]), literal_array(spark, [[nan], [nan], [2.0]])
    assert [math.isnan(r.c0) for r in arithmetic.extreme([x, y], False).df.orderBy("_i").collect()] == [True] * 3
    assert [math.isnan(r.c0) for r in arithmetic.extreme([x, y], True).df.orderBy("_i").collect()] == [True] * 3
    assert [r.c0 for r in arithmetic.replace_nan(x, 7.0).df.orderBy("_i").collect()] == [7.0, 1.0, 7.0]
    assert [r.c0 for r in arithmetic.equality(x, y).df.orderBy("_i").collect()] == [0.0] * 3
    row = spark.range(1).select(*[c.alias(k) for k, c in S.compare(F.lit("NaN"), F.lit("NaN")).items()], S.in_range(F.lit("NaN"), 0, None).alias("r")).first()
    assert row.equal == row.less == row.greater_or_equal == row.r == "false" and row.non_equal == "true"
    m = grid(spark, 2, 1, [F.when(F.col("x") == 0, float("nan")).otherwise(1.0)], "float")
    assert [r.ch0 for r in matrices.equality(m, m, "E1_N0").df.orderBy("x").collect()] == [0.0, 1.0]


def test_percentiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(statistics, "FEW", 500)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=20_000), np.full(5000, 0.25), rng.pareto(0.3, 3000), [float("nan")] * 3])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").select(F.lit(0).cast("long").alias("_i"), "v")
    levels = [0.0, 0.001, 0.25, 0.5, 0.6, 0.99, 0.9999, 1.0]
    found = {r.level: r.value for r in statistics.percentiles(Numbers(frame, ("v",)), levels).collect()}
    order = np.sort(values)
    for p in levels:
        assert found[p] == order[int(math.floor(p * (len(order) - 1) + 0.5))] or math.isnan(found[p]) and p == 1.0


def test_statistics_of_a_part_of_each_block(spark):
    x = literal_array(spark, [[1.0, 2.0, 90.0], [3.0, 4.0, 90.0], [5.0, 6.0, 90.0]])
    r = statistics.all_statistics(x, [0.5, 0.0, 1.0, 0.5], 5, 1.0, 6.0, 0, 2).first()
    assert (r.sum, r.mean, r.number_of_blocks, r.block_length, r.array_length) == (21.0, 3.5, 3, 2, 6)
    assert abs(r.variance - 35 / 12) < 1e-12 and r.percentiles == [4.0, 1.0, 6.0, 4.0] and r.histogram == [1, 1, 1, 1, 1]
    assert r.hash == statistics.all_statistics(x, length_in_block=2).first().hash != statistics.all_statistics(x).first().hash
    with pytest.raises(ValueError):
        statistics.all_statistics(x, [1.5])


def test_positions_over_ties_and_text(spark):
    rows = [(k % 3, f"t{k % 7}", k) for k in range(5000)]
    found = numbered(spark.createDataFrame(rows, "a int, b string, k int").repartition(5), ["a", "b", "k"]).orderBy("_i").collect()
    assert [r._i for r in found] == list(range(5000)) and [(r.a, r.b, r.k) for r in found] == sorted(rows)


def test_csv_over_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n\n3;4\n")
    (tmp_path / "b.csv").write_text("5 6\n 7, 8 \n9\n")
    x, names = files.read_csv(spark, str(tmp_path), "double")
    assert names == ["x", "y"] and [(r._i, r.c0, r.c1) for r in x.df.orderBy("_i").collect()] == [(0, 1, 2), (1, 3, 4), (2, 5, 6), (3, 7, 8), (4, 9, 0)]


def test_zips_of_one_frame_need_no_join(spark):
    x = literal_array(spark, [[1.0, 2.0], [3.0, 4.0]])
    a, b = arithmetic.linear(x.slice(0, 1), a=2.0), arithmetic.negated(x.slice(1, 1)).cast("double")
    out = arithmetic.linear(arithmetic.linear(a, b), x.slice(0, 1))
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and [r[1] for r in out.df.orderBy("_i").collect()] == [1.0, 5.0]
    y = literal_array(spark, [[10.0], [20.0]])
    assert [r[1] for r in arithmetic.linear(a, y).df.orderBy("_i").collect()] == [12.0, 26.0]
