"""Recordings as a Spark data source: ``spark.read.format("recordings")`` and ``df.write.format("recordings")``.

Reading: files are dealt to partitions by size; conditions on ``path`` and ``length`` reach the listing, so files that they
rule out are not opened (with ``spark.sql.python.filterPushdown.enabled``). Writing: each task writes its recordings to a folder
of its own under ``_staging``; the driver moves the files of the tasks that count when all have ended, and removes the
staging folder then, or when the job fails. So a failed job, or a task that ran twice, leaves no file.

Options: ``path``; ``partition_bytes`` (32 MB); ``rate`` (of written files, 16000). Paths may have any scheme that pyarrow knows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

from .audio import EXTENSIONS, SAMPLE_RATE, decode_flac, decode_wav, encode_wav

SCHEMA = "path string, length long, sr int, channels int, bits int, frames long, duration_s double, status string, amp array<double>"
_DECODERS = {".wav": decode_wav, ".flac": decode_flac}


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _ending(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower()


_KEEPS = {
    EqualTo: lambda f, v: v == f.value,
    In: lambda f, v: v in f.value,
    GreaterThan: lambda f, v: v > f.value,
    GreaterThanOrEqual: lambda f, v: v >= f.value,
    LessThan: lambda f, v: v < f.value,
    LessThanOrEqual: lambda f, v: v <= f.value,
    StringStartsWith: lambda f, v: v.startswith(f.value),
    StringEndsWith: lambda f, v: v.endswith(f.value),
}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partition_bytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _KEEPS and f.attribute in (("path",), ("length",)):
                self.filters.append(f)
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) of the recordings that the pushed conditions keep."""
        from pyarrow import fs

        system, at = _opened(self.path)
        one = system.get_file_info(at)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = [(x.path, x.size) for x in found if x.type == fs.FileType.File and _ending(x.path) in EXTENSIONS and "/_" not in x.path[len(at) :]]
        value = {("path",): lambda x: x[0], ("length",): lambda x: x[1]}
        return [x for x in sorted(files) if all(_KEEPS[type(f)](f, value[f.attribute](x)) for f in self.filters)]

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for f in self.listed():
            if out[-1].files and size + f[1] > self.size:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f)
            size += f[1]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system = _opened(self.path)[0]
        for path, size in partition.files:
            decode = _DECODERS.get(_ending(path))
            if decode is None:
                yield path, size, None, None, None, None, None, "unsupported", None
                continue
            with system.open_input_stream(path) as f:
                data = f.read()
            try:
                x, sr, channels, bits = decode(data)
            except Exception:  # whatever a broken file makes a decoder raise, the row says so
                yield path, size, None, None, None, None, None, "corrupt", None
                continue
            yield path, size, sr, channels, bits, len(x), len(x) / sr, "ok", x.tolist()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it is, where it goes)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        missing = {"name", "amp"} - set(schema.names)
        if missing:
            raise ValueError(f"recordings are written from columns name and amp: {sorted(missing)} not there")
        self.path, self.rate, self.overwrite = options["path"].rstrip("/"), int(options.get("rate", SAMPLE_RATE)), overwrite
        system, top = _opened(self.path)
        self.staging = f"{top}/_staging/{uuid.uuid4().hex}"
        system.create_dir(self.staging, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        system, top = _opened(self.path)
        own, files = f"{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=False)  # fails once the job has been given up
        for i, row in enumerate(iterator):
            name = str(row["name"]).replace("/", "_") + ".wav"
            with system.open_output_stream(f"{own}/{i}.wav") as f:
                f.write(encode_wav(np.asarray(row["amp"] if row["amp"] is not None else [], dtype=float), self.rate))
            files.append((f"{own}/{i}.wav", f"{top}/{name}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = _opened(self.path)
        files = [x for m in messages if m for x in m.files]
        double = len(files) - len({to for _, to in files})
        if double:
            self._cleared()
            raise ValueError(f"{double} recordings have a name that another has")
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(top, recursive=False, allow_not_found=True)):
                if x.type == fs.FileType.File and _ending(x.path) == ".wav":
                    system.delete_file(x.path)
        for at, to in files:
            system.move(at, to)
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        from pyarrow import fs

        system, top = _opened(self.path)
        for _ in range(50):
            try:
                if system.get_file_info(self.staging).type == fs.FileType.Directory:
                    system.delete_dir(self.staging)
                break
            except OSError:  # a task that is being ended writes into it still
                time.sleep(0.1)
        left = system.get_file_info(fs.FileSelector(f"{top}/_staging", allow_not_found=True))
        if not left and system.get_file_info(f"{top}/_staging").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/_staging")


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Recordings)
