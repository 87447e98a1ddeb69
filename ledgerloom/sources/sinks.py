"""Sinks with the guarantees that published records need (K*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.store import Audit, Store


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """The listed columns only, with a header (K1)."""
    rows.select(*fields).write.mode("overwrite").csv(path, header=True)


def _with_header(lines: DataFrame, rows: DataFrame, folder: str, order: list[str], header: dict[str, Column]) -> None:
    """Lines of JSON in the order given, as files whose names sort, beside a header of one line; a run replaces both."""
    columns = F.struct(F.array(*map(F.lit, rows.columns)).alias("fields"), *[c.alias(n) for n, c in header.items()])
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(f"{folder}/records")
    rows.agg(F.count("*").alias("n_records")).select(F.to_json(F.struct(columns["fields"].alias("fields"), *[columns[n].alias(n) for n in header], "n_records")).alias("value")).write.mode("overwrite").text(f"{folder}/header")


def write_envelope(rows: DataFrame, folder: str, version: int, order: list[str]) -> None:
    """Records as JSON lines in order, and a header with the schema version, fields and number of records (K2)."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    _with_header(rows.select(*order, line.alias("line")), rows, folder, order, {"schema_version": F.lit(version)})


def write_columnar(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Records as JSON arrays of texts, their names once in the header (K4)."""
    line = F.to_json(F.array(*[F.col(c).cast("string") for c in rows.columns]))
    _with_header(rows.select(*order, line.alias("line")), rows, folder, order, {})


def write_search_index(pages: DataFrame, folder: str, body_cap: int = 600) -> None:
    """Entries of a search index (K12): kind, title, section, url and a body of at most `body_cap` characters, in order of url
    and title; entries without a title are left out, and of equal (url, title) the first by kind stands."""
    entries = pages.filter(F.trim("title") != "").groupBy("url", "title").agg(F.min(F.struct("kind", "section", F.substring("body", 1, body_cap).alias("body"))).alias("e"))
    line = F.to_json(F.struct("e.kind", "title", "e.section", "url", "e.body"))
    _with_header(entries.select("url", "title", line.alias("line")), entries.select("url", "title"), folder, ["url", "title"], {})


def digest(rows: DataFrame, without: list[str] = ()) -> str:
    """A digest of a table's content whatever the order of rows and columns (K5, K6); `without` names timestamps."""
    columns = sorted(c for c in rows.columns if c not in without)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    # Sums of two halves of each row's digest: any order, no collecting.
    parts = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25, 37)]
    found = rows.agg(F.count("*"), *parts).first()
    return ":".join(str(v or 0) for v in found)


def write_if_changed(rows: DataFrame, path: str, stored: DataFrame | None, without: list[str] = ()) -> bool:
    """Writes unless the stored table has the same content, timestamps apart; says whether it wrote (K5).

    The rows may be made from the stored table itself: they are written beside it and then take its place.
    """
    if stored is not None and sorted(stored.columns) == sorted(rows.columns) and digest(stored, without) == digest(rows, without):
        return False
    rows.write.mode("overwrite").parquet(f"{path}_staged")
    _replace(rows.sparkSession, {f"{path}_staged": path})
    return True


def write_report(findings: DataFrame, path: str, key: str, severity: str) -> bool:
    """Writes a report unless the set of (key, severity) is that of the report that stands (K6); says whether it wrote."""
    stored = _stored(findings.sparkSession, f"{path}/findings")
    own = findings.select(F.col(key).cast("string").alias("key"), F.col(severity).cast("string").alias("severity")).distinct()
    if stored is not None and digest(stored.select("key", "severity").distinct()) == digest(own):
        return False
    return write_if_changed(findings.withColumns({"key": F.col(key).cast("string"), "severity": F.col(severity).cast("string")}), f"{path}/findings", None)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def _replace(spark: SparkSession, moves: dict[str, str]) -> None:
    """Moves each folder into its place. What stood there is moved aside first and comes back if a later move fails."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path_of(next(iter(moves))).getFileSystem(conf)
    aside: dict[str, str] = {}
    placed: list[str] = []
    try:
        for new, target in moves.items():
            if files.exists(path_of(target)):
                old = f"{target}_replaced"
                files.delete(path_of(old), True)
                if not files.rename(path_of(target), path_of(old)):
                    raise OSError(f"{target} could not be moved aside")
                aside[target] = old
            if not files.rename(path_of(new), path_of(target)):
                raise OSError(f"{new} could not be moved to {target}")
            placed.append(target)
    except Exception:
        for target in placed:
            files.delete(path_of(target), True)
        for target, old in aside.items():
            files.rename(path_of(old), path_of(target))
        raise
    for old in aside.values():
        files.delete(path_of(old), True)


def write_gated(rows: DataFrame, folder: str, audit: Audit, dry_run: bool = True, table: str = "rows") -> list:
    """Commits the merged rows to the store in a folder only if their audit finds nothing, and never in a dry run (K7).

    Returns some violations. The rows may be made from the store's own; nothing of it is touched until the new state stands.
    """
    outcome = Store(rows.sparkSession, folder).commit({table: rows}, {table: audit}, dry_run=dry_run)
    return outcome.violations.get(table, [])


def write_tables(tables: dict[str, DataFrame], folder: str, valid: dict[str, Column]) -> int:
    """Several tables of a store or none (K8): all are written and read back, and then stand in one step. Returns the version.

    A row for which the named condition does not hold is an error, and nothing changes.
    """
    wrong = {name: (lambda rows, test=test: rows.filter(~F.coalesce(test, F.lit(False)))) for name, test in valid.items()}
    outcome = Store(next(iter(tables.values())).sparkSession, folder).commit(tables, wrong)
    if outcome.violations:
        raise ValueError(f"{', '.join(sorted(outcome.violations))} not valid; nothing was replaced")
    return outcome.version
