"""The lake: versioned tables over Parquet files and a transactional catalog, used through DataFrames and SQL."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os
import re
import shutil
import sqlite3
import threading
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import feed, maintenance
from .operators.write import columns_of, parse_partition_key, parse_sort_key, shaped, write
from .sources.catalog import METADATA_TABLES, Catalog, Conflict, LakeError, changes_text
from .sources.prune import Filter, deterministic, pushed
from .sources.scan import located, scan
from .sources.types import NEVER_INLINE, from_spark, to_spark, widens

OPTIONS = {
    "data_inlining_row_limit": ("0", "Rows up to which an insert is kept in the catalog"),
    "parquet_compression": ("snappy", "Compression of data files"),
    "parquet_compression_level": (None, "Level of the compression"),
    "parquet_version": ("1", "Version of the Parquet format"),
    "parquet_row_group_size": (None, "Rows in a row group"),
    "parquet_row_group_size_bytes": (None, "Bytes in a row group"),
    "target_file_size": (str(512 << 20), "Bytes that merged files aim at"),
    "per_thread_output": ("true", "Whether each task writes its own files"),
    "hive_file_pattern": ("true", "Whether partitioned files lie in folders by key"),
    "rewrite_delete_threshold": ("0.1", "Deleted share of a file from which vacuum rewrites it"),
    "require_commit_message": ("false", "Whether commits need a message"),
    "delete_older_than": ("0 seconds", "Age from which cleanup deletes files"),
    "expire_older_than": (None, "Age from which snapshots expire"),
    "max_records_per_file": (None, "Rows in one data file"),
}
SETTINGS = {"default_table_path": "", "vacuum_delete_threshold": 0.1, "as_of_timestamp": "", "enable_direct_insert": True, "ctas_skip_data": False}


class Transaction:
    """An open transaction: a private catalog at its first statement's snapshot, and the changes to replay."""

    def __init__(self, lake: Lake):
        self.base = lake.catalog.latest()
        self.catalog = lake.catalog.copy()
        self.snap = self.catalog.begin("")
        self.log: list[tuple[str, tuple, dict]] = []


class Lake:
    """A session on a lake.  ``path`` is the catalog file; data files lie below ``data_path``, which may be any URI that Spark and the driver both reach."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str, data_path: str, read_only: bool = False):
        self.spark, self.catalog, self.path, self.data_path, self.read_only = spark, catalog, path, data_path.rstrip("/"), read_only
        self.settings: dict[str, Any] = dict(SETTINGS)
        self.attached: dict[str, Lake] = {}
        self._open: Transaction | None = None
        self._lock = threading.RLock()
        self._message: tuple[str | None, str | None] = (None, None)
        self.id = uuid.uuid4().hex[:8]
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")

    @classmethod
    def open(cls, spark: SparkSession, path: str, data_path: str | None = None) -> Lake:
        """Opens or creates the lake whose catalog lies in folder ``path``."""
        os.makedirs(path, exist_ok=True)
        file = os.path.join(path, "catalog.sqlite")
        return cls(spark, Catalog.open(file), file, data_path or os.path.join(os.path.abspath(path), "data"))

    @classmethod
    def attach_frozen(cls, spark: SparkSession, file: str, data_path: str) -> Lake:
        """A frozen catalog file, read-only."""
        return cls(spark, Catalog.open(file, read_only=True), file, data_path, read_only=True)

    def attach(self, name: str, path: str, data_path: str | None = None, frozen: bool = False) -> Lake:
        """Makes another lake's tables readable as ``name.table`` in SQL; writing to them is refused."""
        file = path if frozen else os.path.join(path, "catalog.sqlite")
        if not os.path.exists(file):
            raise LakeError(f"no catalog at {path}")
        other = Lake(self.spark, Catalog.open(file, read_only=True), file, data_path or os.path.join(os.path.abspath(os.path.dirname(file)), "data"), read_only=True)
        self.attached[name] = other
        return other

    # State and commits.

    @property
    def cat(self) -> Catalog:
        return self._open.catalog if self._open else self.catalog

    def _at(self) -> int:
        if self._open:
            return self._open.snap
        if self.settings["as_of_timestamp"]:
            return self.cat.at_time(dt.datetime.fromisoformat(str(self.settings["as_of_timestamp"])))
        return self.cat.latest()

    def _table(self, name: str, at: int | None = None) -> dict:
        found = self.cat.table(name, self._at() if at is None else at)
        if not found:
            raise LakeError(f'table "{name}" is not a lake table')
        return found

    def set_commit_message(self, message: str | None, author: str | None = None) -> None:
        """Goes with the next commit."""
        self._message = (author, message)

    def _commit(self, log: list[tuple[str, tuple, dict]], base: int | None = None) -> int | None:
        """Makes the changes in one snapshot, or in the open transaction."""
        if self.read_only:
            raise LakeError("attached tables are read-only")
        if self.settings["as_of_timestamp"]:
            raise LakeError("cannot write while as_of_timestamp is set")
        if not log:
            return None
        if self._open:
            for method, args, how in log:
                getattr(self._open.catalog, method)(self._open.snap, *args, **how)
            self._open.log += log
            return None
        with self._lock:
            db = self.catalog.db
            db.execute("BEGIN IMMEDIATE")
            try:
                author, message = self._message
                if self.catalog.option("require_commit_message") == "true" and not message:
                    raise LakeError("a commit message is required")
                if base is not None and self.catalog.latest() > base:
                    self._check(log, base)
                snap = self.catalog.begin(changes_text(log), author, message)
                for method, args, how in log:
                    getattr(self.catalog, method)(snap, *args, **how)
                db.execute("COMMIT")
                self._message = (None, None)
                return snap
            except BaseException:
                db.execute("ROLLBACK")
                raise

    def _check(self, log: list[tuple[str, tuple, dict]], base: int) -> None:
        """Appends go with anything; deletes and changed definitions only if no later snapshot deleted from the same files or changed the same table."""
        later = self.catalog.rows("SELECT changes_made FROM snapshot_changes WHERE snapshot_id > ?", base)
        altered = {m for r in later for m in re.findall(r'(?:altered_table|dropped_table):"([^"]+)"', r["changes_made"])}
        for method, args, _ in log:
            if args[0] in altered and method not in ("create_table", "create_schema"):
                raise Conflict(f'another transaction has changed table "{args[0]}"')
        for method, args, _ in log:
            if method == "add_deletes":
                for d in args[1]:
                    if self.catalog.one("SELECT 1 FROM delete_file d JOIN data_file f USING (data_file_id) WHERE f.path = ? AND d.begin_snapshot > ?", d["data_path"], base):
                        raise Conflict("another transaction has deleted rows of the same file")
            if method == "end_files":
                for path in args[1]:
                    if self.catalog.one("SELECT 1 FROM delete_file d JOIN data_file f USING (data_file_id) WHERE f.path = ? AND d.begin_snapshot > ?", path, base):
                        raise Conflict("another transaction has deleted rows of the same file")

    def begin(self) -> None:
        if self._open:
            raise LakeError("a transaction is already open")
        self._open = Transaction(self)

    def commit(self) -> int | None:
        """Commits the open transaction; without one, or without changes, nothing happens."""
        tx, self._open = self._open, None
        if tx is None or not tx.log:
            return None
        return self._commit(tx.log, base=tx.base)

    def rollback(self) -> None:
        self._open = None

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Lake]:
        """All statements inside see one snapshot and their own changes, and become one snapshot."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    # Tables.

    def create_table(self, name: str, schema: str | T.StructType | list[dict], if_not_exists: bool = False, temporary: bool = False) -> None:
        """``schema`` is DDL text, a StructType, or [{name, type, nullable, default}] with lake types."""
        if temporary:
            raise LakeError("temporary lake tables are not supported")
        if if_not_exists and self.cat.table(name, self._at()):
            return
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema) if schema.strip() else T.StructType()
        if isinstance(schema, T.StructType):
            schema = [{"name": f.name, "type": from_spark(f.dataType), "nullable": f.nullable, "default": f.metadata.get("CURRENT_DEFAULT")} for f in schema]
        self._commit([("create_table", (name, schema, str(uuid.uuid4()), self._base()), {})])

    def _base(self) -> str:
        """Where new tables go, if not below the data path."""
        path = str(self.settings["default_table_path"]).rstrip("/")
        return f"{path}/" if path else ""

    def create_table_as(self, name: str, df: DataFrame) -> int:
        """Creates and fills a table in one snapshot; returns the rows written."""
        columns = columns_of(df)
        table_uuid = str(uuid.uuid4())
        numbered = [{"column_id": i + 1, "column_name": c["name"], "column_type": c["type"], "initial_default": None, "default_value": None, "nulls_allowed": 1} for i, c in enumerate(columns)]
        log: list = [("create_table", (name, columns, table_uuid, self._base()), {})]
        files = [] if self.settings["ctas_skip_data"] else write(df, self.data_path, {"path": f"{self._base()}{table_uuid}/"}, numbered, [], [], self._options(None))
        if files:
            log.append(("add_files", (name, files), {}))
        self._commit(log)
        return sum(f["record_count"] for f in files)

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        if not (if_not_exists and self.cat.has_schema(name)):
            self._commit([("create_schema", (name, str(uuid.uuid4())), {})])

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if if_exists and not self.cat.table(name, self._at()):
            return
        self._table(name)
        self._commit([("drop_table", (name,), {})])

    def rename_table(self, name: str, new: str) -> None:
        self._table(name)
        self._commit([("rename_table", (name, new), {})])

    def add_column(self, name: str, column: str, kind: str, default: str | None = None) -> None:
        """``kind`` is a Spark or lake type name, ``default`` SQL text that old rows read, too."""
        self._table(name)
        lake_type = kind if kind == "varchar" or not isinstance(to_spark(kind), T.StringType) else from_spark(T._parse_datatype_string(kind))
        self._commit([("add_column", (name, {"name": column, "type": lake_type, "default": default}), {})])

    def drop_column(self, name: str, column: str) -> None:
        """Sort and partition keys on the column are reset with it."""
        table, at = self._table(name), self._at()
        log: list = []
        if any(re.search(rf"(?i)\b{re.escape(column)}\b", k["expression"]) for k in self.cat.sort_keys(table["table_id"], at)):
            log.append(("set_sort", (name, []), {}))
        if any(k["column_name"] == column for k in self.cat.partition_keys(table["table_id"], at)):
            log.append(("set_partition", (name, []), {}))
        self._commit([*log, ("change_column", (name, column), {})])

    def rename_column(self, name: str, column: str, new: str) -> None:
        self._table(name)
        self._commit([("change_column", (name, column), {"column_name": new})])

    def alter_type(self, name: str, column: str, kind: str) -> None:
        """To a wider type; others would make old files unreadable and are refused."""
        table = self._table(name)
        old = next((c for c in self.cat.columns(table["table_id"], self._at()) if c["column_name"] == column), None)
        new = from_spark(T._parse_datatype_string(kind))
        if old and not widens(old["column_type"], new):
            raise LakeError(f"cannot change column {column} from {old['column_type']} to {new}: only widening is supported")
        self._commit([("change_column", (name, column), {"column_type": new})])

    def set_default(self, name: str, column: str, default: str | None) -> None:
        self._table(name)
        self._commit([("change_column", (name, column), {"default_value": default})])

    # Layout.

    def set_partition(self, name: str, *keys: str) -> None:
        """``col`` or year|month|day|hour(col); files written from now on hold one tuple of values each."""
        self._table(name)
        if not keys or any(k is None or not str(k).strip() for k in keys):
            raise LakeError("partition keys cannot be NULL or empty")
        try:
            parsed = [parse_partition_key(k) for k in keys]
        except ValueError as e:
            raise LakeError(str(e)) from None
        self._commit([("set_partition", (name, parsed), {})])

    def reset_partition(self, name: str) -> None:
        self._table(name)
        self._commit([("set_partition", (name, []), {})])

    def get_partition(self, name: str) -> DataFrame:
        keys = self.cat.partition_keys(self._table(name)["table_id"], self._at())
        return self.spark.createDataFrame([(k["partition_key_index"], k["column_name"], k["transform"]) for k in keys], "partition_key_index long, column_name string, transform string")

    def set_sort(self, name: str, *keys: str) -> None:
        """``expr [ASC|DESC] [NULLS FIRST|LAST]``; flush and vacuum write files in this order."""
        table = self._table(name)
        if not keys or any(k is None or not str(k).strip() for k in keys):
            raise LakeError("sort keys cannot be NULL or empty")
        try:
            parsed = [parse_sort_key(k) for k in keys]
        except ValueError as e:
            raise LakeError(str(e)) from None
        rows = scan(self.spark, self.cat, self.data_path, table, self._at())
        rows.limit(0).selectExpr(*[k[0] for k in parsed])  # unknown columns fail here
        self._commit([("set_sort", (name, parsed), {})])

    def reset_sort(self, name: str) -> None:
        self._table(name)
        self._commit([("set_sort", (name, []), {})])

    def get_sort(self, name: str) -> DataFrame:
        keys = self.cat.sort_keys(self._table(name)["table_id"], self._at())
        return self.spark.createDataFrame([(k["sort_key_index"], k["expression"], k["sort_direction"], k["null_order"]) for k in keys], "sort_key_index long, expression string, direction string, null_order string")

    # Reading.

    def snapshot_at(self, version: int | None = None, timestamp: dt.datetime | str | None = None) -> int:
        if version is not None:
            return self.cat.at_version(int(version))
        if timestamp is not None:
            return self.cat.at_time(dt.datetime.fromisoformat(timestamp) if isinstance(timestamp, str) else timestamp)
        return self._at()

    def scanned(self, name: str, version: int | None = None, timestamp: dt.datetime | str | None = None, **how: Any) -> DataFrame:
        """The scan of a table, or of one of an attached lake; ``how`` goes to it."""
        if name is None:
            raise LakeError("table name cannot be NULL")
        prefix, _, plain = name.partition(".")
        if prefix in self.attached:
            return self.attached[prefix].scanned(plain, version, timestamp, **how)
        at = self.snapshot_at(version, timestamp)
        return scan(self.spark, self.cat, self.data_path, self._table(name, at), at, **how)

    def files_of(self, name: str, version: int | None = None, timestamp: dt.datetime | str | None = None) -> int:
        """How many data files the table has."""
        prefix, _, plain = name.partition(".")
        if prefix in self.attached:
            return self.attached[prefix].files_of(plain, version, timestamp)
        at = self.snapshot_at(version, timestamp)
        return self.cat.one("SELECT count(*) n FROM data_file WHERE table_id = ? AND begin_snapshot <= ? AND (end_snapshot IS NULL OR end_snapshot > ?)", self._table(name, at)["table_id"], at, at)["n"]

    def table(self, name: str, version: int | None = None, timestamp: dt.datetime | str | None = None, filters: list[Filter] | None = None) -> DataFrame:
        """The table now, at a version or at a time.  ``filters`` (column, operator, value) prune files and are applied to rows, too."""
        rows = self.scanned(name, version, timestamp, filters=filters)
        for column, op, value in filters or ():
            c = F.col(f"`{column}`")
            rows = rows.where({"=": lambda: c == value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(list(value))}[op]())  # noqa: B023
        return rows

    def _bound(self, value: int | dt.datetime | str) -> int:
        return self.cat.at_version(value) if isinstance(value, int) else self.snapshot_at(timestamp=value)

    def table_insertions(self, name: str, start: int | dt.datetime | str, end: int | dt.datetime | str) -> DataFrame:
        return feed.insertions(self.spark, self.cat, self.data_path, self._table(name, self._bound(end)), self._bound(start), self._bound(end))

    def table_deletions(self, name: str, start: int | dt.datetime | str, end: int | dt.datetime | str) -> DataFrame:
        return feed.deletions(self.spark, self.cat, self.data_path, self._table(name, self._bound(end)), self._bound(start), self._bound(end))

    def table_changes(self, name: str, start: int | dt.datetime | str, end: int | dt.datetime | str) -> DataFrame:
        return feed.changes(self.spark, self.cat, self.data_path, self._table(name, self._bound(end)), self._bound(start), self._bound(end))

    def metadata_table(self, name: str) -> DataFrame:
        """A catalog table as it is, all values as text but for integers."""
        if name not in METADATA_TABLES:
            raise LakeError(f"no metadata table {name}")
        kinds = [(r["name"], "long" if r["type"] == "INTEGER" else "binary" if r["type"] == "BLOB" else "string") for r in self.cat.rows(f'PRAGMA table_info("{name}")')]
        rows = [tuple(r.values()) for r in self.cat.rows(f'SELECT * FROM "{name}"')]
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in kinds))

    def snapshots(self) -> DataFrame:
        rows = self.cat.rows("SELECT s.snapshot_id, s.snapshot_time, s.schema_version, c.changes_made, c.author, c.commit_message FROM snapshot s JOIN snapshot_changes c USING (snapshot_id) ORDER BY 1")
        rows = [(r["snapshot_id"], dt.datetime.fromisoformat(r["snapshot_time"]), r["schema_version"], r["changes_made"], r["author"], r["commit_message"]) for r in rows]
        return self.spark.createDataFrame(rows, "snapshot_id long, snapshot_time timestamp, schema_version long, changes string, author string, commit_message string")

    def current_snapshot(self) -> int:
        return self._at()

    def last_committed_snapshot(self) -> int:
        return self.catalog.latest()

    def table_info(self) -> DataFrame:
        at, rows = self._at(), []
        for t in self.cat.tables(at):
            files, deletes = self.cat.live("data_file", t["table_id"], at), self.cat.live("delete_file", t["table_id"], at)
            rows.append((t["schema_name"], t["table_name"], t["table_id"], t["table_uuid"], len(files), sum(f["file_size_bytes"] for f in files), len(deletes), sum(d["delete_count"] for d in deletes)))
        return self.spark.createDataFrame(rows, "schema_name string, table_name string, table_id long, table_uuid string, file_count long, file_size_bytes long, delete_file_count long, deleted_rows long")

    def list_files(self, name: str) -> DataFrame:
        """Data files of the table now, each with its delete files' number and rows."""
        at, table = self._at(), self._table(name)
        gone: dict[int, list[int]] = {}
        for d in self.cat.live("delete_file", table["table_id"], at):
            gone.setdefault(d["data_file_id"], []).append(d["delete_count"])
        rows = [(f["path"], f["file_size_bytes"], f["record_count"], len(gone.get(f["data_file_id"], ())), sum(gone.get(f["data_file_id"], ()))) for f in self.cat.live("data_file", table["table_id"], at)]
        return self.spark.createDataFrame(rows, "data_file string, data_file_size_bytes long, record_count long, delete_files long, deleted_rows long")

    # Options.

    def _options(self, table_id: int | None) -> dict:
        return {k: self.cat.option(k, table_id) or default for k, (default, _) in OPTIONS.items() if (self.cat.option(k, table_id) or default) is not None}

    def set_option(self, key: str, value: Any, table: str | None = None) -> None:
        if key not in OPTIONS:
            raise LakeError(f'Unsupported option "{key}"')
        if key == "rewrite_delete_threshold" and not 0 <= float(value) <= 1:
            raise LakeError(f"{key} must lie between 0 and 1")
        table_id = self._table(table)["table_id"] if table else None
        self.cat.set_option(key, str(value).lower() if isinstance(value, bool) else str(value), table_id)

    def options(self) -> DataFrame:
        rows = [(k, text, default, "default", None) for k, (default, text) in OPTIONS.items() if not self.cat.one("SELECT 1 FROM metadata WHERE key = ? AND scope = 'global'", k)]
        names = {t["table_id"]: f"{t['schema_name']}.{t['table_name']}" for t in self.cat.tables(self._at())}
        rows += [(r["key"], OPTIONS[r["key"]][1], r["value"], r["scope"], names.get(r["scope_id"])) for r in self.cat.rows("SELECT * FROM metadata ORDER BY key, scope")]
        return self.spark.createDataFrame(rows, "option_name string, description string, value string, scope string, scope_entry string")

    def set(self, name: str, value: Any) -> None:
        """A session setting."""
        if name not in SETTINGS:
            raise LakeError(f"unknown setting {name}")
        if name == "vacuum_delete_threshold" and not 0 <= float(value) <= 1:
            raise LakeError(f"{value} is outside the valid range for {name} (0 .. 1)")
        self.settings[name] = float(value) if name == "vacuum_delete_threshold" else value

    def reset(self, name: str) -> None:
        self.set(name, SETTINGS[name])

    # Changing rows.

    def insert(self, name: str, df: DataFrame) -> int:
        """Appends; up to data_inlining_row_limit rows stay in the catalog.  Returns the number of rows."""
        table, at = self._table(name), self._at()
        columns = self.cat.columns(table["table_id"], at)
        known = {c["column_name"].lower() for c in columns}
        for c in df.columns:
            if c.lower() not in known:
                raise LakeError(f'column "{c}" of table "{name}" does not exist')
        options = self._options(table["table_id"])
        limit = int(options["data_inlining_row_limit"])
        if limit > 0 and all(c["column_type"] not in NEVER_INLINE for c in columns):
            rows = shaped(df, columns).limit(limit + 1).toArrow()
            if rows.num_rows <= limit:
                return self._inline(name, columns, rows)
        files = write(df, self.data_path, table, columns, self.cat.partition_keys(table["table_id"], at), [], options)
        if files:
            self._commit([("add_files", (name, files), {})])
        return sum(f["record_count"] for f in files)

    def _inline(self, name: str, columns: list[dict], rows: pa.Table) -> int:
        if rows.num_rows:
            rows = rows.rename_columns([f"c{c['column_id']}" for c in columns])
            self._commit([("add_inlined", (name, uuid.uuid4().hex, _ipc(rows), rows.num_rows), {})])
        return rows.num_rows

    def insert_values(self, name: str, rows: list[tuple], columns: list[str] | None = None) -> int:
        table = self._table(name)
        own = self.cat.columns(table["table_id"], self._at())
        names = columns or [c["column_name"] for c in own]
        kinds = {c["column_name"]: to_spark(c["column_type"]) for c in own}
        schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
        return self.insert(name, self.spark.createDataFrame(rows, schema))

    def insert_arrays(self, name: str, arrays: dict[str, list]) -> int:
        """Equal-length lists, one a column, straight into the catalog without a Spark job.

        Falls back to a normal insert if direct inserts are off, a transaction is open, inlining is off or
        the rows exceed its limit, columns are missing, or a type isn't kept inline.
        """
        if not arrays or len({len(v) for v in arrays.values()}) != 1 or not len(next(iter(arrays.values()))):
            raise LakeError("arrays must be non-empty and of equal length")
        table = self._table(name)
        columns = self.cat.columns(table["table_id"], self._at())
        count = len(next(iter(arrays.values())))
        limit = int(self._options(table["table_id"])["data_inlining_row_limit"])
        plain = all(c["column_type"] not in NEVER_INLINE and "<" not in c["column_type"] for c in columns)
        if self.settings["enable_direct_insert"] and not self._open and count <= limit and plain and set(arrays) == {c["column_name"] for c in columns}:
            from pyspark.sql.pandas.types import to_arrow_type

            held = pa.table({f"c{c['column_id']}": pa.array(arrays[c["column_name"]], to_arrow_type(to_spark(c["column_type"]))) for c in columns})
            for c in columns:
                if not c["nulls_allowed"] and held.column(f"c{c['column_id']}").null_count:
                    raise LakeError(f'null value in column "{c["column_name"]}" violates not-null constraint')
            self._commit([("add_inlined", (name, uuid.uuid4().hex, _ipc(held), count), {})])
            return count
        return self.insert_values(name, list(zip(*arrays.values(), strict=True)), list(arrays))

    def _found(self, name: str, build) -> DataFrame:
        """What build(rows) makes of the table's rows with their places, reading only the files that may serve it."""
        table, at, tag = self._table(name), self._at(), f"{self.id}-dml"
        out = build(scan(self.spark, self.cat, self.data_path, table, at, meta=True, tag=tag))
        if self.files_of(name) > 1 and all(alternatives := pushed(out).get(tag, [[]])):
            out = build(scan(self.spark, self.cat, self.data_path, table, at, meta=True, tag=tag, alternatives=alternatives))
        return out

    @contextlib.contextmanager
    def _settled(self, table: dict, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows, written down for as long as a statement reads them if every evaluation might give others."""
        if deterministic(rows):
            yield rows
            return
        where = located(self.data_path, f"{table['path'].rstrip('/')}/tmp-{uuid.uuid4().hex}")
        rows.write.parquet(where)
        try:
            yield self.spark.read.schema(rows.schema).parquet(where)
        finally:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _delete_log(self, name: str, table: dict, places: DataFrame) -> tuple[list, int]:
        """Changes that delete the rows at ``places`` (_path, _pos), and how many they are."""
        at = self._at()
        batches = {b["batch_uuid"] for b in self.cat.live("inlined_batch", table["table_id"], at)}
        log: list = []
        inline = [(r._path, r._pos) for r in places.where(F.col("_path").isin(list(batches))).collect()] if batches else []  # no more than are inlined
        if inline:
            log.append(("delete_inlined", (name, inline), {}))
        in_files = places.where(~F.col("_path").isin(list(batches))) if batches else places
        folder = f"{table['path'].rstrip('/')}/del-{uuid.uuid4().hex}"
        spread = in_files.select(F.col("_path").alias("data_path"), F.col("_pos").alias("pos"))
        spread.repartition("data_path").sortWithinPartitions("data_path", "pos").write.parquet(located(self.data_path, folder))
        written = self.spark.read.schema("data_path string, pos long").parquet(located(self.data_path, folder))
        found = written.groupBy("data_path", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a touched file
        files = {f["path"]: f for f in self.cat.live("data_file", table["table_id"], at)}
        before: dict[int, int] = {}
        for d in self.cat.live("delete_file", table["table_id"], at):
            before[d["data_file_id"]] = before.get(d["data_file_id"], 0) + d["delete_count"]
        whole, deletes = [], []
        for r in found:
            f = files[r.data_path]
            if r.n + before.get(f["data_file_id"], 0) == f["record_count"]:
                whole.append(r.data_path)
            else:
                deletes.append({"data_path": r.data_path, "path": f"{folder}/{r.file}", "delete_count": r.n})
        if whole:
            log.append(("end_files", (name, whole), {}))
        if deletes:
            log.append(("add_deletes", (name, deletes), {}))
        return log, len(inline) + sum(r.n for r in found)

    def delete(self, name: str, where: Column | str | None = None, alias: str | None = None) -> int:
        """Deletes matching rows: their places go to delete files, files without a row left end.  Returns the number of rows."""
        base, table = self.cat.latest(), self._table(name)
        rows = self._found(name, lambda rows: self._where(rows, where, alias or name.rpartition(".")[2]).select("_path", "_pos"))
        log, count = self._delete_log(name, table, rows)
        self._commit(log, None if self._open else base)
        return count

    def _where(self, rows: DataFrame, where: Column | str | None, alias: str) -> DataFrame:
        from .plans.router import matching

        if where is None:
            return rows.alias(alias)
        return matching(self, rows, alias, where) if isinstance(where, str) else rows.alias(alias).where(where)

    def update(self, name: str, assignments: dict[str, Column | str], where: Column | str | None = None, alias: str | None = None) -> int:
        """Deletes matching rows and writes them changed, with their row ids, in one snapshot."""
        base, table = self.cat.latest(), self._table(name)
        columns = self.cat.columns(table["table_id"], self._at())
        kinds = {c["column_name"]: to_spark(c["column_type"]) for c in columns}
        for c in assignments:
            if c not in kinds:
                raise LakeError(f'column "{c}" of table "{name}" does not exist')
        new = [(F.expr(v) if isinstance(v := assignments[c], str) else v).cast(kinds[c]).alias(c) if c in assignments else F.col(f"`{c}`") for c in kinds]
        made = self._found(name, lambda rows: self._where(rows, where, alias or name.rpartition(".")[2]).select(*new, "_row_id", "_path", "_pos"))
        with self._settled(table, made) as rows:
            files = write(rows.drop("_path", "_pos"), self.data_path, table, columns, self.cat.partition_keys(table["table_id"], self._at()), [], self._options(table["table_id"]), row_id=True)
            log, count = self._delete_log(name, table, rows.select("_path", "_pos"))
        if files:
            log.append(("add_files", (name, files), {}))
        self._commit(log, None if self._open else base)
        return count

    def merge(self, name: str, source: DataFrame, on: str, update: dict[str, str] | None = None, insert: dict[str, str] | None = None, delete: bool = False) -> dict[str, int]:
        """Updates (or deletes) rows that a source row matches and inserts source rows without a match, in one snapshot.

        ``on`` and the expressions name the table as t and the source as s.  A row that more than one source row matches is an error.
        """
        matched = [(None, None)] if delete else [(None, update)] if update else []
        return self.merge_rows(name, source, on, matched, [(None, insert)] if insert else [], "t", "s")

    def merge_rows(self, name: str, source: DataFrame, on: str, matched: list[tuple[str | None, dict[str, str] | None]], inserts: list[tuple[str | None, dict[str, str]]], target: str, other: str) -> dict[str, int]:
        """MERGE with any names for its two sides.

        ``matched`` has (condition, assignments), for a row that a source row matches; None as assignments
        deletes it.  ``inserts`` has (condition, values) for source rows without a match.  The first clause whose
        condition holds, or that has none, acts.  A row to be updated that more than one source row
        matches is an error; one to be deleted goes once.
        """
        base, table = self.cat.latest(), self._table(name)
        columns = self.cat.columns(table["table_id"], self._at())
        kinds = {c["column_name"]: to_spark(c["column_type"]) for c in columns}
        options, keys = self._options(table["table_id"]), self.cat.partition_keys(table["table_id"], self._at())
        log: list = []
        done = {"updated": 0, "deleted": 0, "inserted": 0}
        files: list[dict] = []

        def clause(conditions: list[str | None]) -> Column:
            chosen = F
            for i, c in enumerate(conditions):
                chosen = chosen.when(F.expr(c) if c is not None else F.lit(True), F.lit(i))
            return chosen

        if matched:
            picked = clause([c for c, _ in matched])

            def value(c: str) -> Column:
                out = F.lit(None)
                for i, (_, sets) in reversed(list(enumerate(matched))):
                    out = F.when(F.col("_clause") == i, F.expr((sets or {}).get(c, f"{target}.`{c}`")).cast(kinds[c])).otherwise(out)
                return out.cast(kinds[c]).alias(c)

            made = self._found(name, lambda rows: rows.alias(target).join(source.alias(other), F.expr(on)).withColumn("_clause", picked).where("_clause IS NOT NULL").select(*[value(c) for c in kinds], f"{target}._row_id", f"{target}._path", f"{target}._pos", "_clause"))
            going = F.col("_clause").isin([i for i, (_, sets) in enumerate(matched) if sets is None])
            with self._settled(table, made) as rows:
                if any(sets is not None for _, sets in matched):
                    if not rows.groupBy("_path", "_pos").agg(F.count(F.lit(1)).alias("n"), F.max(~going).alias("changed")).where("n > 1 AND changed").isEmpty():
                        raise LakeError("a row matches more than one source row")
                    files += write(rows.where(~going).drop("_path", "_pos", "_clause"), self.data_path, table, columns, keys, [], options, row_id=True)
                log, count = self._delete_log(name, table, rows.select("_path", "_pos").distinct())
            done["updated"] = sum(f["record_count"] for f in files)
            done["deleted"] = count - done["updated"]
        if inserts:
            rows = scan(self.spark, self.cat, self.data_path, table, self._at(), meta=True)
            missing = source.alias(other).join(rows.alias(target), F.expr(on), "left_anti").withColumn("_clause", clause([c for c, _ in inserts]))
            for i, (_, values) in enumerate(inserts):
                added = write(missing.where(F.col("_clause") == i).select(*[F.expr(v).alias(c) for c, v in values.items()]), self.data_path, table, columns, keys, [], options)
                done["inserted"] += sum(f["record_count"] for f in added)
                files += added
        if files:
            log.append(("add_files", (name, files), {}))
        self._commit(log, None if self._open else base)
        return done

    # Maintenance.

    def flush_inlined_data(self, name: str | None = None) -> list[tuple[str, str, int]]:
        """Moves inlined rows to files, in the tables' sort order: (schema, table, rows)."""
        return maintenance.flush(self, name)

    def vacuum(self, name: str, verbose: bool = False) -> list[str]:
        """Rewrites files with many deleted rows, then merges small files."""
        return maintenance.vacuum(self, name)

    def expire_snapshots(self, older_than: dt.datetime | None = None, versions: list[int] | None = None) -> list[int]:
        return maintenance.expire(self, older_than, versions)

    def cleanup_old_files(self, older_than: dt.timedelta | None = None) -> list[str]:
        return maintenance.cleanup(self, older_than)

    def freeze(self, path: str | None) -> None:
        """Copies the catalog to a single file that can be attached read-only."""
        if path is None:
            raise LakeError("output_path cannot be NULL")
        target = sqlite3.connect(path)
        try:
            self.catalog.db.backup(target)
            for name in ("files_scheduled_for_deletion", "metadata"):
                target.execute(f'DELETE FROM "{name}"')
            target.commit()
            target.execute("PRAGMA journal_mode=DELETE")
        finally:
            target.close()

    # SQL.

    def sql(self, text: str, args: Any = None) -> DataFrame:
        """A statement of the lake's SQL; statements without rows return a one-row tag."""
        from .plans.router import run

        return run(self, text, args)

    def close(self) -> None:
        self.catalog.db.close()

    def remove(self) -> None:
        """Deletes the catalog and, where they are local, the data files."""
        self.close()
        shutil.rmtree(os.path.dirname(self.path), ignore_errors=True)


def _ipc(rows: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_file(out, rows.schema) as writer:
        writer.write_table(rows.combine_chunks())
    return out.getvalue()
