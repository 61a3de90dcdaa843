"""A log of numbered commit files, each created once and by one writer only.

Data is written to a folder of its own first; a commit then names it. Commit n + 1 can only be made by a writer that has seen commit n:
a second one finds the file there, reads the newer state and tries again. Readers follow the last commit, so a job
that dies leaves an unnamed folder and the old state.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sentinel.functions.storage import create_once, list_dir, read_text, remove_dir

FOLDER = "_commits"
PATIENCE_S = 30.0


@dataclass(frozen=True)
class CommitLog:
    spark: SparkSession
    root: str

    def _path(self, number: int) -> str:
        return f"{self.root.rstrip('/')}/{FOLDER}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in list_dir(self.spark, f"{self.root.rstrip('/')}/{FOLDER}") if n.endswith(".json"))

    def read(self, number: int) -> dict:
        """A commit's entry. A store without atomic content may show the file before its text, so an empty one is read again."""
        until = time.monotonic() + PATIENCE_S
        while not (text := read_text(self.spark, self._path(number))):
            if time.monotonic() > until:
                raise RuntimeError(f"commit {number} of {self.root} has no content")
            time.sleep(0.1)
        return json.loads(text)

    def last(self) -> tuple[int, dict | None]:
        """Number and entry of the newest commit; (0, None) if there is none."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def append(self, after: int, entry: dict) -> bool:
        """Make the commit that follows ``after``; False if another writer has made it."""
        return create_once(self.spark, self._path(after + 1), json.dumps(entry))

    def folder(self, entry: dict) -> str:
        return f"{self.root.rstrip('/')}/{entry['folder']}"

    def new_folder(self, prefix: str) -> str:
        return f"{prefix}-{uuid.uuid4().hex}"

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data folders of all but the last ``keep`` commits; returns how many. Readers of those must have ended."""
        found = self.numbers()
        gone = 0
        used = {self.read(n)["folder"] for n in found[-keep:]}
        for n in found[:-keep]:
            folder = self.read(n)["folder"]
            if folder not in used and list_dir(self.spark, f"{self.root.rstrip('/')}/{folder}"):
                remove_dir(self.spark, f"{self.root.rstrip('/')}/{folder}")
                gone += 1
        return gone
