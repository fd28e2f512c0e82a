"""A data source of .npy volumes that is split by byte ranges: a frame of any size is read by as many tasks as it has slabs."""

from __future__ import annotations

import io
import json
import math
import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import volumes

#: Bytes of a slab, about.
SLAB_BYTES = 64 << 20
#: Tasks from which on neighbouring slabs share one, until it has SLAB_BYTES.
TASKS = 1 << 8
#: Bytes that a slab counts at least.
LEAST_BYTES = 1 << 12


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. Whatever Arrow can open is read: local folders and object stores."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(urlparse(path).path) if path.startswith("file:") else path)
    return fs.FileSystem.from_uri(path)


class Slab:
    def __init__(self, path: str, given: str, number: int, count: int, size: int):
        self.path, self.given, self.number, self.count, self.size = path, given, number, count, size


class Slabs(InputPartition):
    """Slabs that one task reads."""

    def __init__(self, slabs: list[Slab]):
        self.slabs = slabs


class NpyVolumes(DataSource):
    """spark.read.format("npy_volumes").load(path): path, x, y, hist, error like volumes.unpack(), of all .npy volumes (x, y, bin) of whole numbers at or below path.

    Options: offset (bins left out at the front), slabBytes (over TASKS slabs share tasks), and files, a JSON list of the files to read instead of a path. The driver lists names and sizes only; each task reads an array's header and then
    its own pixels' bytes, in steps of some thousand pixels. A file that is no such volume, or that ends early, is one row
    with the error. Files are not changed while they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_volumes"

    def schema(self) -> str:
        return "path string, x int, y int, hist array<bigint>, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SlabReader(self.options)


class SlabReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.offset = int(options.get("offset", 0))
        self.slab = int(options.get("slabBytes", SLAB_BYTES))

    def partitions(self) -> list[InputPartition]:
        slabs = []
        for given in self.paths:
            store, path = _store(given)
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(given)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
            for f in sorted((f for f in found if f.is_file and f.path.endswith(".npy")), key=lambda f: f.path):
                count = max(1, math.ceil(f.size / self.slab))
                slabs += [Slab(f.path, given, k, count, max(LEAST_BYTES, f.size // count)) for k in range(count)]
        share = min(SLAB_BYTES, sum(s.size for s in slabs) / TASKS) if len(slabs) > TASKS else 0
        parts, held = [Slabs([])], 0
        for slab in slabs:
            if held and held + slab.size > share:
                parts.append(Slabs([]))
                held = 0
            parts[-1].slabs.append(slab)
            held += slab.size
        return parts

    def read(self, part: Slabs) -> Iterator[pa.RecordBatch]:
        for slab in part.slabs:
            yield from self._slab(slab)

    def _slab(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        try:
            with _store(slab.given)[0].open_input_file(slab.path) as file:
                yield from self._pixels(slab, file)
        except Exception as e:  # any broken file becomes a row
            if slab.number == 0 or not isinstance(e, NoVolume):  # all slabs see the same header
                values = [slab.path, None, None, None, str(e)[:200]]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(values, volumes._KINDS, strict=True)], names=volumes.NAMES)

    def _pixels(self, slab: Slab, file: BinaryIO) -> Iterator[pa.RecordBatch]:
        begin, shape, kind = _header(file)
        nx, ny, bins = shape
        each = bins * kind.itemsize
        low, high = (nx * ny * k // slab.count for k in (slab.number, slab.number + 1))
        for at in range(low, high, volumes.BATCH):
            n = min(volumes.BATCH, high - at)
            file.seek(begin + at * each)
            data = file.read(n * each)
            if len(data) < n * each:
                raise ValueError(f"the file ends inside pixel {at + len(data) // max(1, each)}")
            counts = np.frombuffer(data, kind).reshape(n, bins)[:, self.offset :].astype(np.int64)
            number = np.arange(at, at + n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
            yield pa.record_batch([pa.array([slab.path] * n, pa.string()), pa.array((number // ny).astype(np.int32)), pa.array((number % ny).astype(np.int32)), lists, pa.nulls(n, pa.string())], names=volumes.NAMES)


class NoVolume(ValueError):
    """A file that is no volume of whole numbers."""


def _header(file: BinaryIO) -> tuple[int, tuple[int, int, int], np.dtype]:
    """Where an array's values begin, its shape and kind."""
    try:
        head = io.BytesIO(file.read(1 << 16))
        version = np.lib.format.read_magic(head)
        shape, turned, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    except Exception as e:
        raise NoVolume(f"no array file: {e}") from None
    if len(shape) != 3 or not np.issubdtype(kind, np.integer):
        raise NoVolume(f"not a volume of whole numbers: {kind}, {len(shape)} dimensions")
    if turned:
        raise NoVolume("the volume is laid out by columns")
    return head.tell(), shape, kind


def read_slabs(spark: SparkSession, path: str | list[str], offset: int = 0, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """NpyVolumes of all .npy files at or below path, or of a list of files."""
    spark.dataSource.register(NpyVolumes)
    reader = spark.read.format("npy_volumes").option("offset", offset).option("slabBytes", slab_bytes)
    return reader.load(path) if isinstance(path, str) else reader.option("files", json.dumps(path)).load()


def write_volumes(waveforms: DataFrame, path: str, shape: tuple[int, int, int], kind: str = "int64") -> DataFrame:
    """frame_id and path of a .npy volume for each frame below path, zero where it has no pixel; the result must be computed for the files to be there.

    A frame's pixels meet in one task, shape[0] * shape[1] at most: pixels and bins outside the shape are left out. Files are written
    under another name and then renamed, so that a task that is run again leaves whole files only.
    """

    def run(table: pa.Table) -> pa.Table:
        store, folder = _store(path)
        store.create_dir(folder)
        volume = np.zeros(shape, kind)
        hists = table.column("hist").combine_chunks()
        lengths = hists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x, y = (table.column(c).to_numpy()[row] for c in ("x", "y"))
        good = at < shape[2]
        volume[x[good], y[good], at[good]] = hists.flatten().to_numpy(zero_copy_only=False)[good]
        name = f"{folder}/{table.column('frame_id')[0].as_py()}.npy"
        buffer = io.BytesIO()
        np.save(buffer, volume)
        part = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(buffer.getbuffer())
        store.move(part, name)
        return pa.table([table.column("frame_id")[:1], pa.array([name])], names=["frame_id", "path"])

    inside = waveforms.where(F.col("x").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1)).select("frame_id", "x", "y", "hist")
    return inside.groupBy("frame_id").applyInArrow(run, f"frame_id {waveforms.schema['frame_id'].dataType.simpleString()}, path string")
