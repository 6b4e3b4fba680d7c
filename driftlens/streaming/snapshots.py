"""State of a long-running job as Parquet folders named by a manifest, which is replaced as a whole.

Folders are written under names of their own and never changed. A commit writes the next manifest beside and renames it: what a
reader finds is one manifest's state, old or new, wherever a job dies. Folders that neither of the last two manifests names are
deleted by the commit after. One job writes at a time; of two that commit the same number, the later one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder of the state, but for drafts."""
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName()[0] not in "._") if self._fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The last one committed; number 0 before the first."""
        found = self.names("manifests")
        return json.loads(self._text(f"manifests/{found[-1]}")) if found else {"number": 0}

    def rename(self, draft: str, name: str) -> None:
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            raise RuntimeError(f"{self.path}/{name} is there already")

    def commit(self, state: dict) -> dict:
        """Make state, with the next number, the last manifest."""
        state = state | {"number": state["number"] + 1}
        draft = f"manifests/_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.rename(draft, f"manifests/{state['number']:012d}")
        self._clean(state)
        return state

    def _clean(self, state: dict) -> None:
        kept = self.names("manifests")[-2:]
        held = "".join(self._text(f"manifests/{n}") for n in kept)
        for n in self.names("manifests")[:-2]:
            self._fs.delete(self._at(f"manifests/{n}"), False)
        for folder in self.names("data"):
            if folder not in held:
                self._fs.delete(self._at(f"data/{folder}"), True)

    def write(self, df: DataFrame, name: str) -> str:
        """df as a new folder; nothing names it before the next commit, which deletes it if its manifest doesn't."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def read(self, *folders: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])
