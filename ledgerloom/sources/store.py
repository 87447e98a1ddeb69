"""A store of tables that changes as a whole or not at all (K7, K8, Q5).

Tables lie in snapshots that never change once written. The state is what the newest entry of the commit log names; an entry is a small
file that is put in its place in one step and only if that place is free, so of two writers that start from the same state one commits
and the other is told. Readers take the entry that is newest when they open the store and keep it, whatever is written meanwhile.

A writer may die anywhere: until its entry stands, its files belong to no state, and `sweep` removes them later. Nothing that an
entry of the log still names is ever moved or overwritten.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An audit gets the merged table as written and returns what is wrong with it.
Audit = Callable[[DataFrame], DataFrame]
SHOWN = 20


class StoreChanged(RuntimeError):
    """Another writer has committed since the state that a change was made from."""


@dataclass(frozen=True)
class State:
    """An entry of the log: its number, and the folder and number of rows of each table."""

    version: int
    tables: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    note: str = ""


@dataclass(frozen=True)
class Outcome:
    """What a commit came to: the version that stands now, what the audits found by table, and what changed."""

    version: int
    committed: bool
    violations: dict[str, list] = field(default_factory=dict)
    changes: dict[str, dict[str, int]] = field(default_factory=dict)


class Store:
    """Tables under a folder of any file system that Spark reads.

    on_step is called with the name of each step before it is taken: write, check, publish, done.
    """

    def __init__(self, spark: SparkSession, folder: str, on_step: Callable[[str], None] = lambda step: None) -> None:
        self.spark, self.folder, self.on_step = spark, folder.rstrip("/"), on_step
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(self._conf)

    # The log.

    def _listed(self, folder: str) -> list:
        place = self._path(folder)
        return list(self._files.listStatus(place)) if self._files.exists(place) else []

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._listed(f"{self.folder}/log"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> State:
        """The newest state, or an older one; version 0 is the empty store."""
        versions = self.versions()
        if version is None:
            version = versions[-1] if versions else 0
        if version == 0:
            return State(0)
        if version not in versions:
            raise ValueError(f"the store has no version {version}")
        stream = self._files.open(self._path(self._entry(version)))
        try:
            found = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return State(found["version"], found["tables"], found["rows"], found["note"])

    def _entry(self, version: int) -> str:
        return f"{self.folder}/log/{version:020d}.json"

    def _publish(self, state: State) -> None:
        """Puts the entry in its place, whole and only if that is free."""
        draft, place = f"{self.folder}/drafts/{uuid.uuid4().hex}.json", self._entry(state.version)
        for folder in ("drafts", "log"):
            self._files.mkdirs(self._path(f"{self.folder}/{folder}"))
        stream = self._files.create(self._path(draft), False)
        stream.write(json.dumps({"version": state.version, "tables": state.tables, "rows": state.rows, "note": state.note}).encode())
        stream.close()
        taken = StoreChanged(f"version {state.version} of {self.folder} was committed by another writer")
        if self._files.getUri().getScheme() == "file":  # a local rename would replace what stands there; a link does not
            local = lambda name: self._path(name).toUri().getPath()
            try:
                os.link(local(draft), local(place))
            except FileExistsError:
                raise taken from None
            finally:
                self._files.delete(self._path(draft), False)
            return
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(draft), self._path(place), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                self._files.delete(self._path(draft), False)
                raise taken from None
            raise

    # Reading and writing.

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._table(self.state(version), table)

    def _table(self, state: State, table: str) -> DataFrame:
        if table not in state.tables:
            raise ValueError(f"version {state.version} of {self.folder} has no table {table}")
        return self.spark.read.parquet(f"{self.folder}/{state.tables[table]}")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one state."""
        state = self.state(version)
        return {name: self._table(state, name) for name in state.tables}

    def commit(self, tables: dict[str, DataFrame], audits: dict[str, Audit] | None = None, base: int | None = None, key: dict[str, list[str]] | None = None, note: str = "", dry_run: bool = False) -> Outcome:
        """Replaces some tables, or none.

        Tables are written beside the state and read again; audits look at what was read. If they find nothing, and it is no dry run,
        the state that has them becomes the newest. Tables may be made from those of the state that they replace. base: the version
        that they were made from, the newest if none; another commit since then is an error and changes nothing. key: for tables
        whose changes are to be counted as added, removed and changed rows, the columns of their key.
        """
        state = self.state(base)
        if base is not None and self.state().version != base:
            raise StoreChanged(f"{self.folder} is at version {self.state().version}, not {base}")
        folder = f"snapshots/{uuid.uuid4().hex}"
        try:
            self.on_step("write")
            for name, rows in tables.items():
                rows.write.parquet(f"{self.folder}/{folder}/{name}")
            self.on_step("check")
            written = {name: self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{folder}/{name}") for name, rows in tables.items()}
            violations = {name: found for name, audit in (audits or {}).items() if (found := audit(written[name]).limit(SHOWN).collect())}
            changes = {name: self._changes(state, name, written[name], columns) for name, columns in (key or {}).items()}
            if violations or dry_run:
                self._remove(folder)
                return Outcome(state.version, False, violations, changes)
            counts = {name: rows.count() for name, rows in written.items()}
            self.on_step("publish")
            self._publish(State(state.version + 1, state.tables | {name: f"{folder}/{name}" for name in tables}, state.rows | counts, note))
        except Exception:
            self._remove(folder)
            raise
        self.on_step("done")
        return Outcome(state.version + 1, True, {}, changes)

    def restore(self, version: int, note: str = "") -> Outcome:
        """Makes an older state the newest, as a commit of its own."""
        old, newest = self.state(version), self.state()
        self.on_step("publish")
        self._publish(State(newest.version + 1, old.tables, old.rows, note or f"version {version} again"))
        self.on_step("done")
        return Outcome(newest.version + 1, True)

    def _changes(self, state: State, name: str, rows: DataFrame, columns: list[str]) -> dict[str, int]:
        if name not in state.tables:
            return {"added": rows.count(), "removed": 0, "changed": 0}
        whole = lambda frame: frame.select(F.struct(*columns).alias("k"), F.xxhash64(*sorted(frame.columns)).alias("h"))
        old, new = whole(self._table(state, name)).withColumnRenamed("h", "o"), whole(rows).withColumnRenamed("h", "n")
        counts = old.join(new, "k", "full").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o") != F.col("n")).alias("changed"))
        return counts.first().asDict()

    # What dead writers leave.

    def _remove(self, folder: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{folder}"), True)

    def forget(self, keep: int) -> list[int]:
        """Takes all entries but the newest `keep` out of the log; `sweep` then removes what only they named."""
        old = self.versions()[: -max(1, keep)]
        for version in old:
            self._files.delete(self._path(self._entry(version)), False)
        return old

    def sweep(self, older_than: float = 7 * 86_400) -> list[str]:
        """Removes snapshots and drafts that no entry names and that are older than so many seconds, which must be more than a commit
        takes. Returns their names. A sweep that dies is done again by the next."""
        named = {path.split("/")[1] for version in self.versions() for path in self.state(version).tables.values()}
        gone, now = [], time.time() * 1000
        for part in ("snapshots", "drafts"):
            for found in self._listed(f"{self.folder}/{part}"):
                name = found.getPath().getName()
                if name not in named and found.getModificationTime() <= now - older_than * 1000:
                    self._files.delete(found.getPath(), True)
                    gone.append(f"{part}/{name}")
        return sorted(gone)
