"""Operators on files and folders of the driver's machine, and images as frames of pixels."""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxgrid.model import Matrix


def matching(name: str, glob: str) -> bool:
    """A glob with alternatives in braces."""
    alternatives = re.search(r"\{([^}]*)\}", glob)
    globs = [glob[: alternatives.start()] + a + glob[alternatives.end() :] for a in alternatives[1].split(",")] if alternatives else [glob]
    return any(fnmatch.fnmatchcase(name, g) for g in globs)


def list_of_files(
    folder: str, glob: str = "*", expression: str = "", order: str = "STANDARD", recursive: bool = False, absolute: bool = True,
    strip: bool = False, required: bool = True,
) -> list[str]:
    """Sorted files of a folder."""
    root = Path(folder)
    if not root.is_dir():
        if required:
            raise FileNotFoundError(folder)
        return []

    def walk(at: Path) -> list[Path]:
        entries = sorted(at.iterdir())
        files = [p for p in entries if p.is_file()]
        inner = [q for p in entries if p.is_dir() for q in walk(p)] if recursive else []
        if order == "STANDARD":
            return sorted([*files, *inner])
        return [*inner, *files] if order == "SUBDIRECTORIES_FIRST" else [*files, *inner]

    found = [p for p in walk(root) if matching(p.name, glob) and (not expression or re.fullmatch(expression, str(p).lower()))]
    out = [str(p.absolute() if absolute else p.relative_to(root)) for p in found]
    return [os.path.splitext(p)[0] for p in out] if strip else out


class FileIterator:
    """Next file of a list at each step; starts again after the last."""

    def __init__(self, files: list[str]):
        self.files, self.index = files, -1

    def step(self) -> dict:
        """Path, place and whether it is the last."""
        if not self.files:
            return {"output": None, "file_index": 0, "number_of_files": 0, "last": True}
        self.index = (self.index + 1) % len(self.files)
        return {
            "output": self.files[self.index], "file_index": self.index, "number_of_files": len(self.files),
            "last": self.index == len(self.files) - 1,
        }


def existence(path: str, when_missing="0", when_given="1") -> dict[str, str]:
    """Whether a path exists, as a file or a folder."""
    flag = lambda b: str(b).lower()
    return {
        "output": when_given if os.path.exists(path) else when_missing,
        "is_existing_file": flag(os.path.isfile(path)),
        "is_existing_folder": flag(os.path.isdir(path)),
    }


def changed_extension(name: str, extension: str = "", keep_when_empty: bool = False) -> str:
    """A file name with another extension."""
    if not extension:
        return name if keep_when_empty else re.sub(r"\.[^./\\]*$", "", name)
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", extension):
        raise ValueError(f"not an extension: {extension}")
    return re.sub(r"\.[^./\\]*$", "", name) + "." + extension.lstrip(".")


def copy_or_move(source: str, target: str, glob: str = "*", move: bool = False) -> list[str]:
    """A file, or the files of a folder that match, put in a target."""
    do = shutil.move if move else shutil.copy2
    if os.path.isfile(source):
        return [str(do(source, target))]
    os.makedirs(target, exist_ok=True)
    return [str(do(p, os.path.join(target, os.path.basename(p)))) for p in list_of_files(source, glob)]


def create_folder(path: str, parents: bool = True) -> str:
    """A folder, if there is none."""
    Path(path).mkdir(parents=parents, exist_ok=True)
    return os.path.join(os.path.abspath(path), "")


def remove_files(path: str, glob: str = "*", required: bool = True) -> int:
    """A file, or the files of a folder that match; how many."""
    if os.path.isfile(path):
        os.remove(path)
        return 1
    found = list_of_files(path, glob, required=required)
    for p in found:
        os.remove(p)
    return len(found)


def remove_folder(path: str, required: bool = True) -> None:
    """A folder with all it holds."""
    if not os.path.isdir(path):
        if required:
            raise FileNotFoundError(path)
        return
    shutil.rmtree(path)


OPERATIONS = {
    "CHECK_EXISTENCE": os.path.exists,
    "CHECK_FOLDER_EXISTENCE": os.path.isdir,
    "CHECK_FILE_EXISTENCE": os.path.isfile,
    "CHECK_PARENT_EXISTENCE": lambda p: os.path.isdir(os.path.dirname(p)),
}


def resolve(path: str, child: str = "", security: str = "HIGH", operation: str = "NONE") -> dict[str, str]:
    """A child path and its parts; HIGH security keeps it below its parent."""
    whole = os.path.abspath(os.path.join(path, child))
    if security == "HIGH" and child and os.path.commonpath([os.path.abspath(path), whole]) != os.path.abspath(path):
        raise ValueError(f"{child} leaves {path}")
    if operation in OPERATIONS and not OPERATIONS[operation](whole):
        raise FileNotFoundError(whole)
    if operation.startswith("CREATE"):
        target = os.path.dirname(whole) if "FILE" in operation or operation.startswith("CREATE_PARENT") else whole
        Path(target).mkdir(parents="PARENTS" in operation, exist_ok=True)
        if "FILE" in operation:
            Path(whole).touch()
    return {"absolute_path": whole, "parent_folder": os.path.dirname(whole), "file_name": os.path.basename(whole)}


def read_image(spark: SparkSession, path: str) -> Matrix:
    """An image as pixels in red, green, blue order, through Spark's image source."""
    row = spark.read.format("image").load(path)
    head = row.select("image.width", "image.height", "image.nChannels").first()
    width, height, channels = head
    # one row for each line; a line's pixels are slices of its bytes
    lines = row.select("image.data", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    cells = lines.select("data", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    place = (F.col("y") * width + F.col("x")) * channels
    order = [2, 1, 0, 3][:channels] if channels > 1 else [0]
    value = lambda k: F.conv(F.hex(F.substring(F.col("data"), place + k + 1, F.lit(1))), 16, 10).cast("smallint")
    return Matrix(cells.select("x", "y", *[value(o).alias(f"ch{k}") for k, o in enumerate(order)]), (width, height), channels, "byte")


def write_png(m: Matrix, path: str) -> None:
    """A byte matrix of 1, 3 or 4 channels as a PNG file; an image is one object of known size."""
    kind = {1: 0, 3: 2, 4: 6}[m.channels]
    width, height = m.dims
    frame = m.df.toPandas()
    data = np.zeros((height, width, m.channels), np.uint8)
    data[frame["y"], frame["x"]] = frame[m.names].to_numpy()
    raw = np.concatenate([np.zeros((height, 1), np.uint8), data.reshape(height, -1)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def write_matrix(m: Matrix, folder: str) -> None:
    """A matrix as a table of pixels with its size and kind beside it."""
    m.df.write.mode("overwrite").parquet(os.path.join(folder, "pixels"))
    meta = m.df.sparkSession.range(1).select(
        F.array(*[F.lit(d) for d in m.dims]).alias("dims"), F.lit(m.channels).alias("channels"), F.lit(m.kind).alias("kind")
    )
    meta.write.mode("overwrite").json(os.path.join(folder, "meta"))


def read_matrix(spark: SparkSession, folder: str) -> Matrix:
    """A matrix that write_matrix wrote."""
    meta = spark.read.json(os.path.join(folder, "meta")).first()
    return Matrix(spark.read.parquet(os.path.join(folder, "pixels")), tuple(meta.dims), meta.channels, meta.kind)


def image_formats() -> str:
    """Formats that images are read from and written to, one a line."""
    return "\n".join(["read: bmp", "read: gif", "read: jpeg", "read: png", "write: png"])


def next_image(spark: SparkSession, files: FileIterator) -> tuple[Matrix | None, dict]:
    """The next image of a list of files, and its place."""
    step = files.step()
    return (read_image(spark, step["output"]) if step["output"] else None), step
