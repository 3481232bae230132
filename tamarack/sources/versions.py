"""Sets of tables that are replaced all at once, and tables that grow by merged runs.

A set lies in a folder: data in folders of their own, never written twice, and in _versions one small
file for each state of the set, which says where each table's slices lie. A state is published by
moving its file into place, after all data is written; readers take the newest. So a reader between
two steps sees the old set, whole, and one that has begun to read goes on with the files it found.
One writer at a time: a second one that has taken the same number fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class TableSet:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the states that are kept, in order."""
        if not self._fs.exists(self._path("_versions")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("_versions"))]
        return sorted(int(n[:12]) for n in names if n.endswith(".json"))

    def state(self, number: int | None = None) -> dict:
        """The newest state, or one of the others: its number, tables (slice: folder) and facts."""
        numbers = self.numbers()
        if not numbers:
            return {"number": 0, "tables": {}, "facts": {}}
        name = f"{numbers[-1] if number is None else number:012d}.json"
        return json.loads(self.spark.read.text(f"{self.folder}/_versions/{name}", wholetext=True).first()[0])

    def names(self) -> list[str]:
        return sorted(self.state()["tables"])

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """All slices of a table."""
        slices = self.state(number)["tables"].get(name)
        if not slices:
            raise FileNotFoundError(f"no table {name} in {self.folder}")
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in slices.values()])

    def stage(self, df: DataFrame, name: str) -> str:
        """Data written beside all else; nobody sees it before it is published."""
        path = f"data/{uuid.uuid4().hex}/{name}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def publish(self, tables: dict[str, dict[str, str]], facts: dict | None = None, base: dict | None = None) -> int:
        """Make a state of the newest one (or of `base`, if it is still that) with these tables in place of those of their names."""
        old = self.state() if base is None else base
        number = old["number"] + 1
        new = {"number": number, "tables": old["tables"] | tables, "facts": old["facts"] | (facts or {})}
        target, staged = self._path("_versions", f"{number:012d}.json"), self._path("_versions", f".{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(json.dumps(new).encode())
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise RuntimeError(f"state {number} of {self.folder} was published by another writer")
        return number

    def write(self, tables: dict[str, DataFrame], facts: dict | None = None) -> int:
        """Replace these tables, whole and together; tables may be made of what they replace."""
        base = self.state()
        return self.publish({name: {"": self.stage(df, name)} for name, df in tables.items()}, facts, base)

    def replace_slice(self, name: str, piece: str, df: DataFrame) -> int:
        """Replace one slice of a table, a dataset's rows for instance; the other slices stay where they are."""
        base = self.state()
        return self.publish({name: base["tables"].get(name, {}) | {piece: self.stage(df, name)}}, None, base)

    def prune(self, keep: int = 2) -> None:
        """Delete all states but the newest `keep`, and data that none of these names. No one may be reading or writing what goes."""
        numbers = self.numbers()
        used = {p.split("/")[1] for n in numbers[-keep:] for slices in self.state(n)["tables"].values() for p in slices.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path("_versions", f"{n:012d}.json"), False)
        for f in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)


class MergedRuns:
    """A table kept up by batches, at a cost that follows the batches.

    `merge` makes one table of rows of several (the latest of each key, sums of partial sums), so that
    merge(merge(a) + b) is merge(a + b). A batch is merged in itself and becomes a run. Two neighbouring
    runs are merged when the older has not GROWTH times the rows of the newer, so a row is written again
    about log(rows) times, and there are about log(rows) runs. Readers merge the runs.
    """

    GROWTH = 3

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame]):
        self.tables, self.merge = TableSet(spark, folder), merge

    def read(self) -> DataFrame:
        return self.merge(self.tables.read("runs"))

    def runs(self) -> list[int]:
        """Rows of the runs, the oldest first."""
        return [r for _, r in self.tables.state()["facts"].get("runs", [])]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch; one that was taken in before, by its number, changes nothing."""
        state = self.tables.state()
        if batch <= state["facts"].get("batch", -1):
            return
        runs = [(tuple(r)) for r in state["facts"].get("runs", [])]
        runs.append(self._run(self.merge(rows)))
        while len(runs) > 1 and runs[-2][1] < self.GROWTH * runs[-1][1]:
            both = self.tables.spark.read.parquet(*[f"{self.tables.folder}/{p}" for p, _ in runs[-2:]])
            runs[-2:] = [self._run(self.merge(both))]
        self.tables.publish({"runs": {f"{k:04d}": path for k, (path, _) in enumerate(runs)}}, {"runs": runs, "batch": batch}, state)

    def _run(self, rows: DataFrame) -> tuple[str, int]:
        path = self.tables.stage(rows, "runs")
        return path, self.tables.spark.read.parquet(f"{self.tables.folder}/{path}").count()  # from the files' footers
