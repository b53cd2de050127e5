"""Tables that change hands at once.

A writer puts new tables into folders of their own and then adds one manifest file that names them; readers
follow the newest manifest. A writer that dies before that leaves everything as it was, and of two writers
that start from the same manifest the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

_MANIFESTS = "_manifests"


class Published:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _system(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{_MANIFESTS}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _newest(self) -> tuple[int, dict[str, str]]:
        system, path = self._system()
        if not system.exists(path):
            return 0, {}
        names = [s.getPath().getName() for s in system.listStatus(path)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        rows = self.spark.read.text(f"{self.folder}/{_MANIFESTS}/{max(numbers):08d}.json", wholetext=True)
        return max(numbers), json.loads(rows.first()[0])

    def current(self) -> dict[str, str]:
        """Folder of each table, below this one."""
        return self._newest()[1]

    def path(self, name: str) -> str:
        """Where the table is now; a table that was never handed over is where its name says."""
        return f"{self.folder}/{self.current().get(name, name)}"

    def fresh(self) -> str:
        """A new folder's name, for tables that are not yet handed over."""
        return f"_tables/{uuid.uuid4().hex}"

    def hand_over(self, tables: Mapping[str, str], based_on: int | None = None) -> int:
        """Make ``tables`` (name to folder) the current ones beside those that stay, and return the manifest's
        number. With ``based_on``, it fails if another hand-over came after that number."""
        number, known = self._newest()
        if based_on is not None and based_on != number:
            raise RuntimeError(f"the tables in {self.folder} have changed since manifest {based_on}")
        system, path = self._system()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        draft = hadoop(f"{self.folder}/{_MANIFESTS}/.{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps({**known, **tables}, sort_keys=True).encode()))
        out.close()
        final = hadoop(f"{self.folder}/{_MANIFESTS}/{number + 1:08d}.json")
        # A rename gives readers the whole manifest or none.
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise RuntimeError(f"the tables in {self.folder} have changed since manifest {number}")
        return number + 1

    def number(self) -> int:
        return self._newest()[0]
