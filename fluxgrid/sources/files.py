"""File sources and sinks of number arrays, texts and JSON.

Readers use Spark's own sources, so any file system that Spark reads works; writers give one file per
partition in the order of positions.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, to_kind

NUMPY = {"byte": "u1", "short": "u2", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}


def resolved_path(path: str, base: str | None = None, properties: dict[str, str] | None = None, secure: bool = False) -> str:
    """A path with ${...} properties and %TEMP% replaced; secure paths are absolute and have none."""
    if secure and ("${" in path or "%TEMP%" in path or not os.path.isabs(path)):
        raise ValueError(f"not a secure path: {path}")
    known = dict(properties or {})
    known.setdefault("file.name.ext", os.path.basename(base or path))
    known.setdefault("file.name", os.path.splitext(known["file.name.ext"])[0])
    known.setdefault("path.name", os.path.basename(os.path.dirname(base or path)))
    out = re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m[1], m[0]), path)
    if "%TEMP%" in out:
        import tempfile

        out = out.replace("%TEMP%", tempfile.gettempdir())
    return out


def added(path: str, name: str, mode: str = "NONE") -> str:
    """A path with a file-name addition."""
    if mode == "NONE":
        return path
    if mode == "AFTER_ALL_PATH":
        return path + name
    stem = os.path.splitext(name)[0] if mode == "REPLACE_IN_PATH_REMOVING_EXTENSION" else name
    return path.replace("$$$", stem)


def read_csv(spark: SparkSession, path: str, kind: str = "auto", skipped: int = 0) -> tuple[Numbers, list[str]]:
    """Numbers split by commas, semicolons and white space; a first line that holds no numbers is a header.

    The files of a folder follow in the order of their paths, each without its own skipped lines and header.  Short
    rows are padded with 0; the first line of the first file gives the width and the names.  Blank lines don't count.
    """
    texts = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    parts = F.filter(F.split(F.trim("value"), r"[,;\s]+"), lambda c: c != "")
    is_header = F.exists(parts, lambda c: c.try_cast("double").isNull())
    cells, header = first_line(spark, path, texts.select("_file", parts.alias("cells"), is_header.alias("header")), skipped)
    width = len(cells)
    if kind == "auto":
        kind = next((k for k in NUMPY if header and cells[0].startswith(k)), "float")
    # ids ascend within a split without gaps; a row for each split tells how many lines of its file are before it
    lines = texts.withColumn("_line", F.monotonically_increasing_id())
    splits = lines.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = lambda n, order: F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    move = before("_n", Window.partitionBy("_file").orderBy("_block")) - F.col("_first")
    starts = splits.select("_file", "_block", move.alias("_move"), F.sum("_n").over(Window.partitionBy("_file")).alias("_lines"))
    placed = lines.join(F.broadcast(starts), ["_file", "_block"]).withColumn("_place", F.col("_line") + F.col("_move"))
    # a row for each file that has any tells how many of its lines are no rows and how many rows are in the files before
    none = skipped + is_header.cast("bigint")
    heads = placed.where(F.col("_place") == skipped).select("_file", "_lines", none.alias("_none"))
    rows_before = before(F.col("_lines") - F.col("_none"), Window.orderBy("_file"))
    moves = heads.select("_file", "_none", (rows_before - F.col("_none")).alias("_shift"))
    numbered = placed.join(F.broadcast(moves), "_file").where(F.col("_place") >= F.col("_none"))
    numbered = numbered.select((F.col("_place") + F.col("_shift")).cast("bigint").alias("_i"), parts.alias("p"))
    cols = [to_kind(F.coalesce(F.get("p", F.lit(k)).try_cast("double"), F.lit(0.0)), kind).alias(f"c{k}") for k in range(width)]
    return Numbers(numbered.select("_i", *cols), tuple(f"c{k}" for k in range(width)), kind), (cells if header else [])


def first_line(spark: SparkSession, path: str, lines: DataFrame, skipped: int) -> tuple[list[str], bool]:
    """Cells of the first line behind the skipped ones, in the order of paths, and whether it is a header."""
    names = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("_metadata.file_path").alias("_file"))
    name = names.agg(F.min("_file")).first()[0]
    while name is not None:
        found = lines.where(F.col("_file") == name).limit(skipped + 1).collect()
        if len(found) > skipped:
            return found[skipped].cells, found[skipped].header
        # all lines of the file are blank or skipped
        name = names.where(F.col("_file") > name).agg(F.min("_file")).first()[0]
    return [], False


def write_csv(x: Numbers, path: str, names: list[str] | None = None, delimiter: str = ",") -> None:
    """Rows in order under a header of names, or of element kind and number."""
    names = names or [f"{x.kind}_{k + 1}" for k in range(x.block_length)]
    cols = [F.col(c).alias(n) for c, n in zip(x.columns, names)]
    rows = x.df.repartitionByRange("_i").sortWithinPartitions("_i")
    rows.select(*cols).write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def read_raw(spark: SparkSession, path: str, width: int = 1, kind: str = "float", order: str = "big", glob: str | None = None) -> Numbers:
    """Raw numbers of one or many files in the order of their paths; each file holds whole rows and is read by one task."""
    source = spark.read.format("binaryFile")
    if glob:
        source = source.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    size = np.dtype(NUMPY[kind]).itemsize * width
    files = source.load(path)
    sizes = files.select("path", "length")
    before = F.sum("length").over(Window.orderBy("path").rowsBetween(-(1 << 31), -1))
    starts = sizes.select(F.col("path").alias("_path"), (F.coalesce(before, F.lit(0)) / size).cast("bigint").alias("_start"))
    mark = "<" if order == "little" else ">"
    names = [f"c{k}" for k in range(width)]

    def run(batches):
        for b in batches:
            for data, start in zip(b.column("content").to_pylist(), b.column("_start").to_pylist()):
                if len(data) % size:
                    raise ValueError("a file does not hold whole rows")
                values = np.frombuffer(data, mark + NUMPY[kind]).reshape(-1, width).astype("f8")
                index = np.arange(len(values), dtype=np.int64) + start
                yield pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(values[:, k]) for k in range(width)]], ["_i", *names])

    rows = files.join(starts, F.col("path") == F.col("_path")).select("content", "_start")
    df = rows.mapInArrow(run, "_i long, " + ", ".join(f"{n} double" for n in names))
    return Numbers(df, tuple(names), "double").cast(kind)


def raw_metadata(x: Numbers, n: int, names: list[str] | None = None, order: str = "BIG_ENDIAN", base: int = 0) -> str:
    """JSON that describes raw rows; column names and their indexes only where names are given."""
    found = {"blockLength": x.block_length, "n": n, "elementType": x.kind, "byteOrder": order, "order": order}
    if names is not None:
        found |= {"columnNames": names, "columnIndexes": {c: k + base for k, c in enumerate(names)}}
    return json.dumps(found, indent=4)


def write_raw(
    x: Numbers, folder: str, order: str = "big", metadata: bool = False, names: list[str] | None = None, base: int = 0
) -> int:
    """Raw rows in order as files ``rows-<first position>.raw`` of a shared folder; the number of rows.

    Each task writes its range to a file of its own beside and renames it, so a task that runs again leaves the
    same files; their names sort in the order of rows, which is how read_raw reads them.
    """
    from pyarrow import fs

    mark = "<" if order == "little" else ">"
    kind, columns = x.kind, list(x.columns)
    where, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    where.create_dir(root)
    where.delete_dir_contents(root)

    def run(batches):
        target, at = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        out, first, rows, draft = None, None, 0, ""
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                first = b.column("_i")[0].as_py()
                draft = f"{at}/.{first:020d}-{os.getpid()}"
                out = target.open_output_stream(draft)
            values = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            out.write(values.astype(mark + NUMPY[kind]).tobytes())
            rows += b.num_rows
        if out is not None:
            out.close()
            target.move(draft, f"{at}/rows-{first:020d}.raw")
            yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    ranged = x.df.select("_i", *columns).repartitionByRange("_i").sortWithinPartitions("_i")
    n = ranged.mapInArrow(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if metadata:
        with where.open_output_stream(f"{root}.meta") as f:
            f.write(raw_metadata(x, n, names, "LITTLE_ENDIAN" if order == "little" else "BIG_ENDIAN", base).encode())
    return n


def read_scalar(spark: SparkSession, path: str, default: str | None = None) -> str | None:
    """Whole text of a file, or a default where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return default
    return row[0] if row else default


def read_json(spark: SparkSession, path: str, default: str = "{}") -> str:
    """A JSON object of a file, printed with indents."""
    found = json.loads(read_scalar(spark, path, default) or default)
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return json.dumps(found, indent=2)


def scalars_in_folder(spark: SparkSession, folder: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """path, text, index and count of the files of a folder, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = files.option("recursiveFileLookup", str(recursive).lower()).load(folder)

    # one row for each file
    every = Window.orderBy("path")
    return files.select(
        "path",
        F.decode("content", "UTF-8").alias("text"),
        (F.row_number().over(every) - 1).alias("file_index"),
        F.count("*").over(Window.partitionBy()).alias("number_of_files"),
    )
