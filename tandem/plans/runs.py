"""Restartable jobs: named steps in a folder of their own, finished ones found again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "number bigint, step string, entry string, settings string, needs array<string>, path string, schema string"


class Run:
    """The steps of one job under ``folder``.

    A step's table is written first, its manifest entry after; a run that is
    killed in between leaves a table that nothing names. A step is finished if
    its last entry has the same settings and was made from the entries that its
    inputs have now, so a changed step is made again with all that follow from it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, dict] = {}
        try:
            rows = spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            for row in rows.orderBy("number").collect():  # one per finished step
                self._known[row.step] = row.asDict()
        self._number = 1 + max((entry["number"] for entry in self._known.values()), default=0)

    def _finished(self, step: str, settings: str, needs: list[str]) -> dict | None:
        found = self._known.get(step)
        return found if found and (found["settings"], found["needs"]) == (settings, needs) else None

    def _finish(self, step: str, settings: str, needs: list[str], path: str | None, schema: str | None) -> None:
        entry = {
            "number": self._number, "step": step, "entry": uuid.uuid4().hex, "settings": settings, "needs": needs,
            "path": path, "schema": schema,
        }
        rows = self.spark.createDataFrame([tuple(entry.values())], MANIFEST)
        rows.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        self._known[step] = entry
        self._number += 1

    def _wanted(self, settings: Mapping | None, needs: Sequence[str]) -> tuple[str, list[str]]:
        return json.dumps(settings or {}, sort_keys=True, default=str), [self._known[n]["entry"] for n in needs]

    def step(
        self, name: str, make: Callable[[], DataFrame], settings: Mapping | None = None, needs: Sequence[str] = ()
    ) -> DataFrame:
        """The table of a step, made by ``make`` unless it is finished; ``needs`` names the steps it reads."""
        wanted, inputs = self._wanted(settings, needs)
        found = self._finished(name, wanted, inputs)
        if found is None:
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            table = make()
            table.write.parquet(path)
            self._finish(name, wanted, inputs, path, table.schema.json())
            found = self._known[name]
        schema = StructType.fromJson(json.loads(found["schema"]))
        return self.spark.read.schema(schema).parquet(found["path"])

    def effect(
        self, name: str, act: Callable[[], None], settings: Mapping | None = None, needs: Sequence[str] = ()
    ) -> None:
        """Do what leaves no table, unless it is finished; ``act`` may be done again after a kill."""
        wanted, inputs = self._wanted(settings, needs)
        if self._finished(name, wanted, inputs) is None:
            act()
            self._finish(name, wanted, inputs, None, None)
