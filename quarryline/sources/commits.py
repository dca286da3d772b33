"""Numbered commit records in a shared folder, each created whole or not at all, and never over another.

``<root>/_commits/000000000007.json`` is commit 7. Two writers that try one number can't both get it: a local or
mounted file system links a finished file to the name, which fails where the name exists; HDFS renames likewise. Stores
without either are refused.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from urllib.parse import urlparse

from pyarrow import fs


class Conflict(RuntimeError):
    """Another writer has made the commit that this one was to be."""


def resolved(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return fs.LocalFileSystem(), uri.path or path
    return fs.FileSystem.from_uri(path)


class Commits:
    def __init__(self, root: str):
        self.store, self.root = resolved(root.rstrip("/"))
        self.folder = f"{self.root}/_commits"

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def latest(self) -> int:
        """The last commit's number, 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        with self.store.open_input_stream(self._path(number)) as f:
            return json.loads(f.read().decode())

    def create(self, number: int, record: dict) -> None:
        """Raises ``Conflict`` if there is such a commit."""
        self.store.create_dir(self.folder, recursive=True)
        own = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(own) as f:
            f.write(json.dumps(record).encode())
        try:
            if isinstance(self.store, fs.LocalFileSystem):
                os.link(own, self._path(number))
            elif isinstance(self.store, fs.HadoopFileSystem):
                self.store.move(own, self._path(number))
            else:
                raise ValueError(f"{self.store.type_name} can't create a file without overwriting")
        except OSError as e:
            if number in self.numbers():
                raise Conflict(f"commit {number} of {self.root} exists") from e
            raise
        finally:
            with contextlib.suppress(OSError):
                self.store.delete_file(own)

    def append(self, record) -> int:
        """Creates the next commit; whoever loses a number takes the one after. ``record`` makes the record of a number."""
        while True:
            number = self.latest() + 1
            with contextlib.suppress(Conflict):
                self.create(number, record(number))
                return number
