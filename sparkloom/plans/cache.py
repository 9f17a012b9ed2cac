"""A content-addressed cache for stages: results are Parquet under a digest of what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = "1"


def digest(stage: str, inputs: list[str], config: dict) -> str:
    """Digest of a stage's name, its inputs' digests, this engine's version and the settings that matter to it."""
    text = json.dumps([stage, sorted(inputs), VERSION, config], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


class StageCache:
    """Stage results by digest in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, stage: str, key: str) -> str:
        return f"{self.folder}/{stage}/{key}"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def has(self, stage: str, key: str) -> bool:
        """Whether a whole result is there; the writer's success mark comes last."""
        fs, target = self._fs(f"{self._path(stage, key)}/_SUCCESS")
        return fs.exists(target)

    def drop(self, stage: str, key: str) -> None:
        fs, target = self._fs(self._path(stage, key))
        fs.delete(target, True)

    def get(self, stage: str, inputs: list[str], config: dict, make: Callable[[], DataFrame], *, verify: bool = False) -> DataFrame:
        """The stage's result, made and kept if it is not there; with `verify`, a kept one is held against a new one."""
        key = digest(stage, inputs, config)
        path = self._path(stage, key)
        if self.has(stage, key):
            kept = self.spark.read.parquet(path)
            if verify:
                fresh = make()
                if not (kept.exceptAll(fresh).isEmpty() and fresh.exceptAll(kept).isEmpty()):
                    raise ValueError(f"{stage}: the kept result differs from a new one")
            return kept
        make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
