"""Point clouds in LAS files (versions 1.0 to 1.3, point formats 0 to 3): a Python data source that reads ranges of records, and a writer of one file for each partition.

Only the header is read where the scan is planned; each partition then seeks to its own records, decodes them with numpy and hands over Arrow batches. Compressed (LAZ) files are refused.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartosieve.functions import geometry as G
from cartosieve.operators.layers import LayerMeta

COLUMNS = {"x": "double", "y": "double", "z": "double", "intensity": "int", "return_number": "int", "number_of_returns": "int", "classification": "int"}
BATCH = 1 << 16
#: The least length of a record of each point format, and where the header of version 1.2 ends.
RECORD_BYTES, HEADER_BYTES = {0: 20, 1: 28, 2: 26, 3: 34}, 227


@dataclass
class Header:
    first: int  # where the records begin
    kind: int
    size: int  # of a record
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def parse_header(raw: bytes, name: str) -> Header:
    if raw[:4] != b"LASF" or len(raw) < HEADER_BYTES:
        raise ValueError(f"{name} is no LAS file")
    first, _, kind, size, count = struct.unpack_from("<IIBHI", raw, 96)
    if kind & 0x80 or kind not in RECORD_BYTES:
        raise ValueError(f"{name} has point format {kind & 0x7F}{', compressed' if kind & 0x80 else ''}: convert it to LAS with format 0 to 3")
    if size < RECORD_BYTES[kind]:
        raise ValueError(f"{name} has records of {size} bytes")
    return Header(first, kind, size, count, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155))


def decode(raw: bytes, header: Header, columns: list[str]) -> list[np.ndarray]:
    """The wanted columns of whole records."""
    fields = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "flags": ("u1", 14), "class": ("u1", 15)}
    kinds = np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": header.size})
    rows = np.frombuffer(raw, kinds)
    place = lambda c, i: rows[c] * header.scale[i] + header.offset[i]
    made = {
        "x": lambda: place("x", 0), "y": lambda: place("y", 1), "z": lambda: place("z", 2), "intensity": lambda: rows["intensity"].astype(np.int32), "return_number": lambda: (rows["flags"] & 7).astype(np.int32),
        "number_of_returns": lambda: (rows["flags"] >> 3 & 7).astype(np.int32), "classification": lambda: (rows["class"] & 31).astype(np.int32),
    }
    return [made[c]() for c in columns]


def _files(path: str) -> tuple[pa.fs.FileSystem, list[str]]:
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, where = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    if fs.get_file_info(where).type == FileType.Directory:
        return fs, sorted(f.path for f in fs.get_file_info(FileSelector(where)) if f.type == FileType.File and f.path.lower().endswith(".las"))
    return fs, [where]


class Records(InputPartition):
    def __init__(self, number: int, file: str, header: Header, begin: int, end: int):
        self.number, self.file, self.header, self.begin, self.end = number, file, header, begin, end


class LasReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], rows: int):
        self.path, self.columns, self.rows = path, columns, rows

    def partitions(self) -> list[Records]:
        fs, files = _files(self.path)
        found = []
        for file in files:
            with fs.open_input_file(file) as f:
                header = parse_header(f.read(HEADER_BYTES), file)
            found += [(file, header, at, min(at + self.rows, header.count)) for at in range(0, header.count, self.rows)]
        return [Records(i, *x) for i, x in enumerate(found)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(self.path)
        h = partition.header
        with fs.open_input_file(partition.file) as f:
            for at in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                f.seek(h.first + at * h.size)
                raw = f.read(n * h.size)
                if len(raw) < n * h.size:
                    raise ValueError(f"{partition.file} ends before its records do")
                place = (partition.number << 33) + np.arange(at - partition.begin, at - partition.begin + n)
                yield pa.RecordBatch.from_arrays([pa.array(place), *map(pa.array, decode(raw, h, self.columns))], names=["feature_pos", *self.columns])


class LasSource(DataSource):
    """Options: path (a file or a folder of files), columns (comma-separated; default all), rows (records a partition)."""

    @classmethod
    def name(cls) -> str:
        return "cartosieve_las"

    def _columns(self) -> list[str]:
        return self.options["columns"].split(",") if self.options.get("columns") else list(COLUMNS)

    def schema(self) -> str:
        return "feature_pos long, " + ", ".join(f"{c} {COLUMNS[c]}" for c in self._columns())

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], self._columns(), int(self.options.get("rows", 1 << 20)))


def read_las(spark: SparkSession, path: str, columns: tuple[str, ...] = (), rows: int = 1 << 20) -> tuple[DataFrame, LayerMeta]:
    """A layer of points with z and the wanted attributes (none named: all); positions follow files and records. An empty file gives no rows."""
    spark.dataSource.register(LasSource)
    wanted = [c for c in COLUMNS if c in "xyz" or not columns or c in columns]
    points = spark.read.format("cartosieve_las").option("columns", ",".join(wanted)).option("rows", str(rows)).load(path)
    shape = G.single_part("Point", F.array(G.coord(F.col("x"), F.col("y"), F.col("z"))))
    layer = points.select("feature_pos", F.col("feature_pos").cast("string").alias("feature_id"), shape.alias("geometry"), *[c for c in wanted if c not in "xyz"])
    return layer, LayerMeta(os.path.basename(path.rstrip("/")), path)


def write_las(layer: DataFrame, path: str, scale: float = 0.001) -> None:
    """Points as LAS 1.2, point format 0, a file for each partition that has any; attributes by their names in COLUMNS, absent ones 0. Features without geometry are left out.

    A task writes a draft and moves it to the partition's name when it is whole, so that one that runs again leaves one file.
    """
    c = F.get(G.coords(F.col("geometry")), F.lit(0))
    own = [F.coalesce(F.col(n).cast("int"), F.lit(0)).alias(n) if n in layer.columns else F.lit(0).alias(n) for n in COLUMNS if n not in "xyz"]
    rows = layer.where("geometry is not null and size(geometry.parts) > 0").select(*[F.coalesce(c[n], F.lit(0.0)).alias(n) for n in "xyz"], *own)
    where = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(where)
        parts, low, high = [], np.full(3, np.inf), np.full(3, -np.inf)
        for batch in batches:
            xyz = np.stack([batch.column(n).to_numpy() for n in "xyz"], axis=1)
            if len(xyz):
                made = np.zeros(len(xyz), np.dtype([("p", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("rest", "V4")]))
                made["p"] = np.round(xyz / scale)
                made["intensity"], made["class"] = batch.column("intensity").to_numpy(), batch.column("classification").to_numpy() & 31
                made["flags"] = (batch.column("return_number").to_numpy() & 7) | (batch.column("number_of_returns").to_numpy() & 7) << 3
                parts.append(made.tobytes())
                low, high = np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0))
        n = sum(map(len, parts)) // RECORD_BYTES[0]
        if n:
            head = bytearray(HEADER_BYTES)
            head[:4], head[24:26] = b"LASF", bytes((1, 2))
            struct.pack_into("<HIIBHI", head, 94, HEADER_BYTES, HEADER_BYTES, 0, 0, RECORD_BYTES[0], n)
            struct.pack_into("<12d", head, 131, scale, scale, scale, 0, 0, 0, high[0], low[0], high[1], low[1], high[2], low[2])
            task = TaskContext.get()
            draft = f"{folder}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(draft) as out:
                out.write(bytes(head))
                for part in parts:
                    out.write(part)
            fs.move(draft, f"{folder}/part-{task.partitionId():06d}.las")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # runs the tasks; one row
