"""Changes between two snapshots of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import glob_regex, sha256_hex, slashes


def snapshot(frame: DataFrame, path: Column, body: Column, order: Column) -> DataFrame:
    """path, source_hash: the latest version of each path. Rows without a path are no files. Only hashes are shuffled."""
    return latest(frame, path, sha256_hex(F.encode(body, "UTF-8")).alias("source_hash"), order)


def latest(frame: DataFrame, path: Column, value: Column, order: Column) -> DataFrame:
    """path and the named ``value`` of the latest version of each path; the value is taken before the shuffle."""
    rows = frame.select(path.alias("path"), value, order.alias("order")).where("path is not null")
    name = rows.columns[1]
    return rows.groupBy("path").agg(F.max(F.struct("order", name)).getField(name).alias(name))


def changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, kind (Added, Modified, Deleted), source_hash, base_hash of every path that isn't the same in both."""
    both = base.select("path", F.col("source_hash").alias("base_hash"), F.lit(True).alias("in_base")).join(head.select("path", "source_hash", F.lit(True).alias("in_head")), "path", "full")
    kind = F.when(F.col("in_base").isNull(), "Added").when(F.col("in_head").isNull(), "Deleted").otherwise("Modified")
    return both.where("in_base is null or in_head is null or not (base_hash <=> source_hash)").select("path", kind.alias("kind"), "source_hash", "base_hash")


def renames(changed: DataFrame) -> DataFrame:
    """old_path, path, source_hash of added files that have the content of a deleted one. Of several with the same content
    the first by name counts on either side, so that a content stands for one rename."""
    gone = changed.where("kind = 'Deleted' and base_hash is not null").groupBy(F.col("base_hash").alias("source_hash")).agg(F.min("path").alias("old_path"))
    come = changed.where("kind = 'Added' and source_hash is not null").groupBy("source_hash").agg(F.min("path").alias("path"))
    return gone.join(come, "source_hash").select("old_path", "path", "source_hash")


def changed_files(base: DataFrame, head: DataFrame, include: str | None = None, ignored: list[str] | None = None) -> DataFrame:
    """path, kind (Added, Modified, Renamed), source_hash: what there is to do. Deleted files are dropped, then the include
    pattern and the ignore patterns apply."""
    changed = changes(base, head)
    new_names = renames(changed).select("path", F.lit(True).alias("renamed"))
    found = changed.where("kind != 'Deleted'").join(new_names, "path", "left").select("path", F.when(F.col("renamed"), "Renamed").otherwise(F.col("kind")).alias("kind"), "source_hash")
    if include is not None:
        found = found.where(slashes(F.col("path")).rlike(glob_regex(include)))
    return found.where(~is_ignored(F.col("path"), ignored)) if ignored else found


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; one without a slash matches at any depth."""
    tests = []
    for p in patterns:
        tests.append(glob_regex(p))
        if "/" not in p:
            tests.append(glob_regex(f"**/{p}"))
    found = F.lit(False)
    for t in dict.fromkeys(tests):
        found = found | slashes(path).rlike(t)
    return F.coalesce(found, F.lit(False))


def resolve_base(snapshots: DataFrame, ref: str | None, head: str) -> DataFrame:
    """The one row of ``snapshots`` (ref, ts) to compare head with: the named one, or the latest before head's own time; a first snapshot has none.

    An unknown name is an error. There is one row a snapshot, so that the table is small by nature.
    """
    if ref is not None and ref.strip():
        named = snapshots.where((F.col("ref") == ref) | (F.col("ref") == f"origin/{ref}")).orderBy(F.col("ref") != ref).limit(1)
        checked = named.agg(F.first("ref").alias("ref"), F.first("ts").alias("ts"))
        return checked.select(F.when(F.col("ref").isNotNull(), F.col("ref")).otherwise(F.raise_error(F.lit(f"Base reference '{ref}' could not be resolved."))).alias("ref"), "ts")
    at = snapshots.where(F.col("ref") == head).agg(F.max("ts").alias("head_ts"))
    return snapshots.join(F.broadcast(at), F.col("ts") < F.col("head_ts")).agg(F.max(F.struct("ts", "ref")).alias("s")).where("s is not null").select("s.ref", "s.ts")


def base_of_each(snapshots: DataFrame, key: str, ts: str) -> DataFrame:
    """key, head_ts, base_ts: of each key's snapshots in time the last, and the latest before it, none for a first one."""
    last = snapshots.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias("head_ts"))
    earlier = snapshots.join(last, key).where(F.col(ts) < F.col("head_ts")).groupBy(key).agg(F.max(ts).alias("base_ts"))
    return last.join(earlier, key, "left").select(key, "head_ts", "base_ts")


def not_generated(frame: DataFrame, body: str, prefix: str) -> DataFrame:
    """Without what carries a provenance header in its first characters."""
    return frame.where(~F.coalesce(F.startswith(F.col(body), F.lit(prefix)), F.lit(False)))
