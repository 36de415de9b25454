"""Rows of micro-batches in few folders: batches are merged by levels, and a manifest names what counts.

Two runs of batches are merged when the newer one has grown as large as the older, like carries of a
binary counter, so n batches lie in at most log2(n) + 1 folders and a row is written again log2(n) times.
A version file lists the folders and appears by one rename.  What a crash leaves behind is in no version:
it is never read, and the next commit removes it.  The folders of the version before stay, for readers that
have begun with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Run:
    """Consecutive batches in one folder."""

    last: int
    batches: int
    folder: str


class Snapshots:
    """The merged rows of a stream's batches under `path`; one writer, the stream, and any readers.

    `reduce` may drop or combine rows of merged folders where readers see no difference (the newest row
    of a key, sums).  A store belongs to one checkpoint: a batch that is in it already is not written again.
    """

    def __init__(
        self, spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.spark, self.path, self.reduce = spark, path.rstrip("/"), reduce
        self.versions = f"{self.path}/_versions"
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._place = jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        if not self._fs.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place))

    def _version(self, name: str) -> list[Run]:
        stream = self._fs.open(self._place(f"{self.versions}/{name}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        rows = [line.split(" ") for line in text.splitlines() if line]
        return [Run(int(last), int(batches), folder) for last, batches, folder in rows]

    def runs(self) -> list[Run]:
        """The folders of the latest version, oldest batches first."""
        names = [n for n in self._names(self.versions) if n.startswith("v")]
        return self._version(names[-1]) if names else []

    def read(self) -> DataFrame | None:
        """The rows of all batches (not reduced over all folders), or None before the first batch."""
        runs = self.runs()
        return self.spark.read.parquet(*[f"{self.path}/{r.folder}" for r in runs]) if runs else None

    def commit(self, batch: int, rows: DataFrame) -> None:
        """Adds a batch; a batch that is in the latest version is left alone."""
        runs = self.runs()
        if runs and runs[-1].last >= batch:
            return
        runs.append(self._written(batch, 1, rows))
        while len(runs) > 1 and runs[-2].batches <= runs[-1].batches:
            old, new = runs.pop(-2), runs.pop()
            both = self.spark.read.parquet(f"{self.path}/{old.folder}", f"{self.path}/{new.folder}")
            merged = both if self.reduce is None else self.reduce(both)
            runs.append(self._written(new.last, old.batches + new.batches, merged))
        self._switch(batch, runs)
        self._clean()

    def _written(self, last: int, batches: int, rows: DataFrame) -> Run:
        folder = f"run-{last:012d}-{batches}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{folder}")
        return Run(last, batches, folder)

    def _switch(self, batch: int, runs: list[Run]) -> None:
        """Makes `runs` the latest version by renaming a finished file."""
        text = "".join(f"{r.last} {r.batches} {r.folder}\n" for r in runs)
        draft = self._place(f"{self.versions}/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, self._place(f"{self.versions}/v{batch:012d}")):
            raise OSError(f"version {batch} of {self.path} could not be put in place")

    def _clean(self) -> None:
        """Removes folders that neither the latest version nor the one before it names."""
        names = self._names(self.versions)
        versions = [n for n in names if n.startswith("v")]
        named = {r.folder for v in versions[-2:] for r in self._version(v)}
        for name in self._names(self.path):
            if name.startswith("run-") and name not in named:
                self._fs.delete(self._place(f"{self.path}/{name}"), True)
        for name in [*versions[:-2], *(n for n in names if n.startswith("_"))]:
            self._fs.delete(self._place(f"{self.versions}/{name}"), False)
