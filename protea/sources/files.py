"""Files of the Python data sources: listing, and parts that appear only when
their job commits.

Paths go through Arrow's file systems (local and shared folders, HDFS, object
stores), opened by the tasks themselves. A write puts its parts into a folder
beside the target; what a failed or doubled attempt has left there is deleted
at the commit, and the folder then takes the target's place.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import WriterCommitMessage


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it); ``file:/x`` is read as ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        path = os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files by name; names with a
    leading ``_`` or ``.`` are not data."""
    fs, p = filesystem(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(p, info.size)]
    return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(p))
                  if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (file name, first key, rows) of each part."""
    parts: list[tuple[str, int, int]]


class Staging:
    """The folder of one write job, named on the driver."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.folder = f"{self.path}._staged-{uuid.uuid4().hex[:12]}"

    def start(self) -> None:
        """On the driver: make the folder. Tasks don't, so that one that outlives
        its job finds no place to write to."""
        if not self.overwrite:
            try:
                there = bool(data_files(self.path))
            except FileNotFoundError:
                there = False
            if there:
                raise FileExistsError(f"{self.path} has files; write with mode overwrite")
        fs, p = filesystem(self.folder)
        fs.create_dir(p, recursive=True)

    def create(self, suffix: str):
        """(name, output stream) of a part nobody else writes."""
        fs, p = filesystem(self.folder)
        name = f"{uuid.uuid4().hex}{suffix}"
        return name, fs.open_output_stream(f"{p}/{name}", compression=None)

    def publish(self, names: list[str], suffix: str) -> None:
        """The parts ``names``, in this order, become the target's files."""
        fs, staged = filesystem(self.folder)
        _, target = filesystem(self.path)
        keep = {n: f"part-{i:06d}{suffix}" for i, n in enumerate(names)}
        for f in fs.get_file_info(pafs.FileSelector(staged)):
            if f.base_name in keep:
                fs.move(f.path, f"{staged}/{keep[f.base_name]}")
            else:
                fs.delete_file(f.path)
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            fs.delete_dir(target)
        fs.move(staged, target)

    def drop(self) -> None:
        fs, staged = filesystem(self.folder)
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)
