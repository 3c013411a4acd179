"""Flush, vacuum, expiry and cleanup: new files for the same rows, which keep their ids and leave history as it was."""

from __future__ import annotations

import datetime as dt

from ..sources.catalog import LakeError, now
from ..sources.scan import broadcast_places, filesystem, inlined_rows, located, read_files, without_deleted
from .write import sort_columns, write


def flush(lake, name: str | None = None) -> list[tuple[str, str, int]]:
    cat, at = lake.cat, lake._at()
    tables = [t for t in cat.tables(at) if name is None or t["table_id"] == lake._table(name)["table_id"]]
    out = []
    for t in tables:
        batches = cat.live("inlined_batch", t["table_id"], at)
        if not batches:
            continue
        columns, label = cat.columns(t["table_id"], at), f"{t['schema_name']}.{t['table_name']}"
        rows = inlined_rows(lake.spark, cat, t["table_id"], at, columns, batches, meta=True)
        log: list = [("end_inlined", (label, [b["batch_uuid"] for b in batches]), {})]
        count = 0
        if rows is not None:
            sort = cat.sort_keys(t["table_id"], at)
            if sort:
                rows = rows.coalesce(1).sortWithinPartitions(*sort_columns(sort))
            files = write(rows.drop("_path", "_pos"), lake.data_path, t, columns, cat.partition_keys(t["table_id"], at), sort, lake._options(t["table_id"]), row_id=True)
            count = sum(f["record_count"] for f in files)
            log.append(("add_files", (label, files), {"silent": True}))
        lake._commit(log)
        out.append((t["schema_name"], t["table_name"], count))
    return out


def vacuum(lake, name: str) -> list[str]:
    """Files with a deleted share of the threshold or more are rewritten, then files below the target size merged, each by partition values."""
    cat, at = lake.cat, lake._at()
    table = lake._table(name)
    base = cat.latest()
    columns, sort = cat.columns(table["table_id"], at), cat.sort_keys(table["table_id"], at)
    options = lake._options(table["table_id"])
    own = cat.option("rewrite_delete_threshold", table["table_id"])
    threshold = float(own) if own is not None else float(lake.settings["vacuum_delete_threshold"])
    files, deletes = cat.live("data_file", table["table_id"], at), cat.live("delete_file", table["table_id"], at)
    gone: dict[int, int] = {}
    for d in deletes:
        gone[d["data_file_id"]] = gone.get(d["data_file_id"], 0) + d["delete_count"]
    rewrite = [f for f in files if f["data_file_id"] in gone and gone[f["data_file_id"]] >= threshold * f["record_count"]]
    target = int(options["target_file_size"])
    rest = [f for f in files if f["data_file_id"] not in gone]
    values: dict[int, tuple] = {}
    for r in cat.rows("SELECT * FROM file_partition_value WHERE table_id = ? ORDER BY partition_key_index", table["table_id"]):
        values[r["data_file_id"]] = (*values.get(r["data_file_id"], ()), r["partition_value"])
    groups: dict[tuple, list[dict]] = {}
    for f in rest:
        if f["file_size_bytes"] < target:
            groups.setdefault((f["partition_id"], values.get(f["data_file_id"])), []).append(f)
    merge = [f for g in groups.values() if len(g) > 1 for f in g]
    said = [f"INFO: vacuuming table {name}"]
    log: list = []
    for what, chosen in (("rewritten", rewrite), ("merged", merge)):
        new: list[dict] = []
        if chosen:
            ids = {f["data_file_id"] for f in chosen}
            dead = [d for d in deletes if d["data_file_id"] in ids]
            size = sum(f["file_size_bytes"] for f in chosen)
            keys = cat.partition_keys(table["table_id"], at)
            parts = max(1, -(-size // target))
            ranged = sort and parts > 1
            streamed = not keys and not ranged and broadcast_places(chosen, dead)
            rows = read_files(lake.spark, chosen, columns, lake.data_path, meta=True, tasks=parts if streamed else None)
            rows = without_deleted(lake.spark, rows, chosen, dead, lake.data_path).drop("_path", "_pos")
            if not keys and ranged:
                rows = rows.repartitionByRange(parts, *sort_columns(sort))
            elif not keys and not streamed:  # coalesced tasks behind a shuffled join would each hold the sorts of many
                rows = rows.repartition(parts)
            new = write(rows, lake.data_path, table, columns, keys, sort, options, row_id=True)
            log.append(("end_files", (name, [f["path"] for f in chosen]), {"silent": True}))
            log.append(("add_files", (name, new), {"silent": True}))
        said.append(f"INFO: {what} {len(chosen)} files into {len(new)}")
    lake._commit(log, None if lake._open else base)
    return said


def _age(text: str | None) -> dt.timedelta | None:
    """``7 days`` as a time span."""
    if not text:
        return None
    number, unit = text.split()
    return dt.timedelta(**{unit.rstrip("s") + "s": float(number)})


def expire(lake, older_than: dt.datetime | None = None, versions: list[int] | None = None) -> list[int]:
    """Forgets snapshots, never the latest; files that no snapshot left shows are scheduled for deletion.

    Without arguments the option expire_older_than says which; without that nothing expires.
    """
    if lake._open:
        raise LakeError("cannot expire snapshots in a transaction")
    cat = lake.catalog
    latest = cat.latest()
    age = _age(cat.option("expire_older_than"))
    if older_than is None and versions is None and age is not None:
        older_than = dt.datetime.now(dt.timezone.utc) - age
    limit = older_than.astimezone(dt.timezone.utc).isoformat(timespec="microseconds") if older_than else None
    going = [r["snapshot_id"] for r in cat.rows("SELECT * FROM snapshot") if r["snapshot_id"] != latest and ((versions is not None and r["snapshot_id"] in versions) or (limit is not None and r["snapshot_time"] < limit))]
    cat.db.execute("BEGIN IMMEDIATE")
    try:
        for s in going:
            cat.db.execute("DELETE FROM snapshot WHERE snapshot_id = ?", (s,))
            cat.db.execute("DELETE FROM snapshot_changes WHERE snapshot_id = ?", (s,))
        unseen = "end_snapshot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.snapshot_id >= begin_snapshot AND s.snapshot_id < end_snapshot)"
        for what in ("data_file", "delete_file"):
            key = f"{what}_id"
            cat.db.execute(f"INSERT INTO files_scheduled_for_deletion SELECT {key}, path, ? FROM {what} WHERE {unseen}", (now(),))
            cat.db.execute(f"DELETE FROM {what} WHERE {unseen}")
        cat.db.execute(f"DELETE FROM inlined_delete WHERE batch_uuid IN (SELECT batch_uuid FROM inlined_batch WHERE {unseen})")
        cat.db.execute(f"DELETE FROM inlined_batch WHERE {unseen}")
        cat.db.execute("COMMIT")
    except BaseException:
        cat.db.execute("ROLLBACK")
        raise
    return going


def cleanup(lake, older_than: dt.timedelta | None = None) -> list[str]:
    """Deletes the files scheduled for deletion, all or those scheduled longer ago than given or than the option delete_older_than; returns their paths."""
    cat = lake.catalog
    limit = (dt.datetime.now(dt.timezone.utc) - (older_than or _age(cat.option("delete_older_than")) or dt.timedelta())).isoformat(timespec="microseconds")
    due = cat.rows("SELECT DISTINCT path FROM files_scheduled_for_deletion WHERE schedule_start <= ?", limit)
    still = {r["path"] for r in cat.rows("SELECT path FROM delete_file")} | {r["path"] for r in cat.rows("SELECT path FROM data_file")}
    out = []
    for r in due:
        if r["path"] not in still:
            where = located(lake.data_path, r["path"])
            files, path = filesystem(where)
            if files.get_file_info(path).is_file:
                files.delete_file(path)
            out.append(r["path"])
        cat.db.execute("DELETE FROM files_scheduled_for_deletion WHERE path = ?", (r["path"],))
    return out


