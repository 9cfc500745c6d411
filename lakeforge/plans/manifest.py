"""Numbered manifests: which folders of a stored table are current.

A load writes its files first and then publishes a manifest under the next number, by a rename that fails if another
load took it.  Readers see the last published state; a load that fails on the way changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..session import hadoop_fs


class ManifestLog:
    """The manifests below ``path``; each is a JSON object with its number as ``load``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, folder = hadoop_fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def latest(self) -> dict | None:
        """The last published state; None if there is none."""
        loads = self._numbers()
        if not loads:
            return None
        lines = self.spark.read.text(f"{self.path}/manifests/{loads[-1]}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def publish(self, state: dict) -> None:
        """Write the manifest aside and rename it into place; refuse if that number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, target = hadoop_fs(self.spark, f"{self.path}/manifests/{state['load']}.json")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{state['load']}-{self.spark.sparkContext.applicationId}.tmp")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"load {state['load']} of {self.path} was published by another writer; read it and try again")
