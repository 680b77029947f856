"""A table that a stream adds to: pieces of Parquet, and small versions of a list of the pieces that count.

A batch stages its piece first and is committed by one more version of the list, a single small file, so readers see whole
batches, and a batch that died between is not there. A batch that is already in the list is not added again. Pieces are
merged in fours by age, so what is written for a row grows with the logarithm of the number of batches, not with the table;
merged pieces and old versions of the list are removed once readers have had time to move on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of one level that become one of the next, and versions for which what was merged away is kept.
FAN, KEPT = 4, 3
Merge = Callable[[DataFrame], DataFrame]


class Store:
    """folder/pieces/<name> and folder/versions/version=<n>; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, merge: Merge | None = None):
        """merge: what becomes of the rows of several pieces (column _age: 0 for the newest); none: all are kept."""
        self.spark, self.folder, self.merge = spark, folder.rstrip("/"), merge
        self._versions = f"{self.folder}/versions"
        if not self._exists(self._versions):
            self._publish({"version": 0, "batch": -1, "note": None, "pieces": [], "gone": []})

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _remove(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _publish(self, state: dict) -> None:
        one = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{self._versions}/version={state['version']}")

    def state(self) -> dict:
        """The newest version: version, batch (the last one added), note, pieces (the oldest first), gone."""
        rows = self.spark.read.schema("value string, version long").text(self._versions)
        return json.loads(rows.agg(F.max_by("value", "version")).first()[0])

    def rows(self, pieces: list[dict] | None = None) -> DataFrame | None:
        """All rows that count, with _age (0: the newest piece); None if there are no pieces."""
        pieces = self.state()["pieces"] if pieces is None else pieces
        out = None
        for age, piece in enumerate(reversed(pieces)):
            one = self.spark.read.parquet(f"{self.folder}/pieces/{piece['name']}").withColumn("_age", F.lit(age))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def merged(self) -> DataFrame | None:
        """rows() as one merge of all pieces, without _age."""
        rows = self.rows()
        return rows if rows is None else (self.merge(rows) if self.merge else rows).drop("_age")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.drop("_age").write.mode("overwrite").parquet(f"{self.folder}/pieces/{name}")

    def add(self, batch: DataFrame, number: int, note: Callable[[object, DataFrame], object] | None = None) -> bool:
        """Adds a batch and commits it; False if it was there already. note(note so far, the staged rows): a value for JSON
        that is committed with it."""
        state = self.state()
        if number <= state["batch"]:
            return False
        name = f"{number}-0"
        self._write(self.merge(batch.withColumn("_age", F.lit(0))) if self.merge else batch, name)
        if note:
            state["note"] = note(state["note"], self.spark.read.parquet(f"{self.folder}/pieces/{name}"))
        pieces = [*state["pieces"], {"name": name, "level": 0}]
        gone = []
        level = 0
        while len(same := [p for p in pieces if p["level"] == level]) >= FAN:
            rows, level = self.rows(same), level + 1
            self._write(self.merge(rows) if self.merge else rows, f"{number}-{level}")
            pieces = [p for p in pieces if p not in same] + [{"name": f"{number}-{level}", "level": level}]
            pieces.sort(key=lambda p: -p["level"])  # of two levels the higher is the older
            gone += [p["name"] for p in same]
        self.commit(state | {"batch": number, "pieces": pieces}, gone)
        return True

    def commit(self, state: dict, gone: list[str] | None = None) -> None:
        """Publishes the next version, then removes what no reader needs any more."""
        version = state["version"] + 1
        waiting = [*state["gone"], *([name, version] for name in gone or [])]
        self._publish(state | {"version": version, "gone": [x for x in waiting if x[1] > version - KEPT]})
        for name, since in waiting:
            if since <= version - KEPT:
                self._remove(f"{self.folder}/pieces/{name}")
        self._remove(f"{self._versions}/version={version - KEPT}")


def newest(keys: list[str], order: str) -> Merge:
    """Of each key the row with the greatest order; ties go to the newer piece, then to the greater row by hash."""

    def merge(rows: DataFrame) -> DataFrame:
        told = F.xxhash64(*[F.col(c) for c in rows.columns if c != "_age"])
        best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.asc("_age"), F.desc(told)))
        return rows.withColumn("_best", best).where("_best = 1").drop("_best")

    return merge


def last_of(keys: list[str]) -> Merge:
    """Of each key the rows of the newest piece that has it."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_least", F.min("_age").over(Window.partitionBy(*keys))).where("_age = _least").drop("_least")

    return merge
