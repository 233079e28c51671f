"""Full paths from parent references.

Three plans give the same paths: pointer doubling over the whole forest, a frontier that only looks up the ancestors of the wanted rows,
and a recursive query. The walk starts at a record and goes on to its parent until it reaches the root, a record it has
seen, one without a name or one that is missing; paths have at most so many components and UTF-16 units.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.functions.text import SEPARATOR, utf16_units
from inodeon.model import MAX_DEPTH, MAX_UNITS, ROOT

#: Up to so many wanted rows the frontier is used, which touches only their ancestors.
FRONTIER_ROWS = 200_000
#: Ancestors that may be sent to all tasks; 16 bytes and a name each.
CLOSED_IDS = 1_000_000
#: Links, 16 bytes each, that are taken as a whole instead of level by level.
WHOLE_LINKS = 4_000_000
#: Rows whose chains are laid out at once.
CHAIN_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine, one of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def lookup(records: DataFrame) -> DataFrame:
    """The hierarchy of all records, whatever is searched for: ``(record_number, parent, name)``; the root has none."""
    rows = records.select("record_number", F.col("parent_record_number").alias("parent"), F.col("file_name").alias("name"))
    return rows.where((F.col("record_number") != ROOT) & (F.length("name") > 0))


def capped_path(components: Column, max_units: int | None = MAX_UNITS) -> Column:
    """Components joined root to leaf; stops before the one with which the path and its end mark would exceed the units.

    Units are counted one component after the other only where the bytes of the whole path, which are no fewer, don't show that it fits.
    """
    whole = F.array_join(components, SEPARATOR)
    if max_units is None:
        return whole

    def step(acc: Column, c: Column) -> Column:
        sep = F.when(acc["units"] > 0, F.lit(1)).otherwise(F.lit(0))
        units = acc["units"] + sep + utf16_units(c)
        stop = acc["stop"] | (units + 1 > max_units)
        return F.struct(F.when(stop, acc["units"]).otherwise(units).alias("units"), stop.alias("stop"), F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"))

    start = F.struct(F.lit(0).alias("units"), F.lit(False).alias("stop"), F.lit(0).alias("n"))
    capped = F.array_join(F.slice(components, F.lit(1), F.aggregate(components, start, step, lambda acc: acc["n"])), SEPARATOR)
    return F.when(F.octet_length(whole) < max_units, whole).otherwise(capped)


def _with_own(rows: DataFrame, chains: DataFrame, max_depth: int | None) -> DataFrame:
    """``(record_number, components)``: what leads to a record's parent, and its own name.

    ``chains`` has ``(start, ids, names)`` of parents, root to leaf. A record that its parent's chain comes back to cuts the chain there.
    """
    joined = rows.join(chains.withColumnRenamed("start", "parent"), "parent", "left")
    return joined.select("record_number", _behind("name", max_depth).alias("components"))


def _behind(name: str, max_depth: int | None) -> Column:
    """The components of a row that has its parent's ``ids`` and ``names``."""
    kept = F.size("ids") - F.array_position("ids", F.col("record_number")).cast("int")
    kept = kept if max_depth is None else F.least(kept, F.lit(max_depth - 1))
    above = F.when(F.col("ids").isNotNull() & (kept > 0), F.slice("names", F.greatest(F.size("ids") - kept + 1, F.lit(1)), kept)).otherwise(F.array().cast("array<string>"))
    return F.array_append(above, F.col(name))


def components_by_doubling(hierarchy: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """``(record_number, components)`` for every named record but the root."""
    return _with_own(hierarchy, chains_by_doubling(hierarchy, max_depth), max_depth)


def chains_by_doubling(hierarchy: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """``(start, ids, names)``, root to leaf, for every named record but the root that has children.

    Only records that are somebody's parent take part in the rounds; files join theirs once afterwards. After k rounds a row holds its lowest
    2**k ancestors and a pointer to the next one; rows that have arrived, or go round in a cycle, leave the left side of the joins, and
    those below the root, which may be very many, never meet on its key. Without a ``max_depth`` the rounds go on until all have left.
    """
    parents = hierarchy.where(F.col("parent") != ROOT).select(F.col("parent").alias("record_number")).distinct()
    up = F.when(F.col("parent") != ROOT, F.col("parent"))
    at = checkpointed(hierarchy.join(parents, "record_number", "left_semi").select("record_number", up.alias("cur"), F.array("record_number").alias("ids"), F.array("name").alias("names")))
    rounds = 64 if max_depth is None else max(1, (max_depth - 1).bit_length())
    for _ in range(rounds):
        going = F.col("cur").isNotNull() & (F.size("ids") == F.size(F.array_distinct("ids")))
        way = at.where(going)
        if way.isEmpty():
            break
        next_up = at.select(F.col("record_number").alias("cur"), F.col("cur").alias("next"), F.col("ids").alias("up_ids"), F.col("names").alias("up_names"))
        moved = way.join(next_up, "cur", "left").select(
            "record_number",
            F.col("next").alias("cur"),
            F.when(F.col("up_ids").isNotNull(), F.concat("up_ids", "ids")).otherwise(F.col("ids")).alias("ids"),
            F.when(F.col("up_names").isNotNull(), F.concat("up_names", "names")).otherwise(F.col("names")).alias("names"),
        )
        at = checkpointed(moved.unionByName(at.where(~going)))
    # the walk stops before the first id that comes again: of a cycle, as many as there are different ones
    kept = F.size(F.array_distinct("ids"))
    return at.select(F.col("record_number").alias("start"), F.slice("ids", -kept, kept).alias("ids"), F.slice("names", -kept, kept).alias("names"))


def ancestors(starts: np.ndarray, links: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """``(ids, parents)``, ids ascending, of all records on the way up from some ids; None if they are more than ``CLOSED_IDS``.

    ``links`` (cur, parent) of few rows come as a whole; else each level joins the different ids that are new, which are broadcast,
    until none is.
    """
    spark = links.sparkSession
    if links.count() <= WHOLE_LINKS:
        found = links.toArrow()
        ids, first = np.unique(found.column("cur").to_numpy(), return_index=True)
        parents = found.column("parent").to_numpy()[first]
        keep, new = np.zeros(len(ids), dtype=bool), np.unique(starts)
        while len(new) and len(ids):
            at = np.minimum(np.searchsorted(ids, new), len(ids) - 1)
            at = at[(ids[at] == new) & ~keep[at]]
            keep[at] = True
            new = np.unique(parents[at])
        return (ids[keep], parents[keep]) if keep.sum() <= CLOSED_IDS else None
    ids, parents, looked, new = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.unique(starts)
    while len(new):
        if len(ids) + len(new) > CLOSED_IDS:
            return None
        looked = np.union1d(looked, new)
        level = links.join(F.broadcast(spark.createDataFrame(pa.table({"cur": new}))), "cur").toArrow()
        ids, parents = (np.concatenate((x, level.column(c).to_numpy())) for x, c in ((ids, "cur"), (parents, "parent")))
        new = np.setdiff1d(level.column("parent").to_numpy(), looked)
    ids, first = np.unique(ids, return_index=True)
    return ids, parents[first]


def components_by_frontier(wanted: DataFrame, hierarchy: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame | None:
    """The same for few wanted records only, or None if their ancestors are too many: the closed set of their ancestors goes to all tasks.

    ``wanted`` has record numbers, or with ``parent`` and ``name`` what the hierarchy says of them. Ids and parents, then the names of the
    ancestors, at most ``CLOSED_IDS`` rows of each, pass the driver.
    """
    spark = hierarchy.sparkSession
    own = wanted.select("record_number", "parent", "name") if {"parent", "name"} <= set(wanted.columns) else hierarchy.join(wanted.select("record_number"), "record_number", "left_semi")
    own = checkpointed(own.select("record_number", "parent", "name"))
    starts = own.where(F.col("parent") != ROOT).select("parent").distinct().toArrow().column("parent").to_numpy()
    closed = ancestors(starts.astype(np.int64), hierarchy.select(F.col("record_number").alias("cur"), "parent"))
    if closed is None:
        return None
    ids, parents = closed
    known = F.broadcast(spark.createDataFrame(pa.table({"record_number": ids})))
    named = hierarchy.join(known, "record_number").select("record_number", "name").toArrow()
    names = pa.array(named.column("name").to_pylist(), pa.string()).take(pa.array(np.unique(named.column("record_number").to_numpy(), return_index=True)[1]))
    tree = spark.sparkContext.broadcast((ids, parents, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHAIN_ROWS):
                part = batch.slice(first, CHAIN_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _chains(part, *tree.value, max_depth)], ["record_number", "components"])

    return own.mapInArrow(run, "record_number long, components array<string>")


def _chains(rows: pa.RecordBatch, ids: np.ndarray, parents: np.ndarray, names: pa.Array, max_depth: int) -> pa.ListArray:
    """Names from the uppermost ancestor down to each row's own; a walk ends before an id that it has seen, or that is unknown."""
    start, cur = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    going = np.ones(len(start), dtype=bool)
    places: list[np.ndarray] = []  # of the ancestors at each level, -1 beyond the end
    while len(places) < max_depth - 1 and len(ids):
        at = np.minimum(np.searchsorted(ids, cur), len(ids) - 1)
        going &= (ids[at] == cur) & (cur != start)
        for level in places:
            going &= at != level
        if not going.any():
            break
        places.append(np.where(going, at, -1))
        cur = parents[at]
    above = np.stack(places[::-1], axis=1) if places else np.empty((len(start), 0), dtype=np.int64)
    # each row's own name stands behind those of all ancestors
    full = np.concatenate((above, len(names) + np.arange(len(start))[:, None]), axis=1)
    lengths = (full >= 0).sum(axis=1)
    values = pa.concat_arrays([names.cast(pa.string()), rows.column(2).cast(pa.string())]).take(pa.array(full[full >= 0]))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)


def components_by_recursion(wanted: DataFrame, hierarchy: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The same as one recursive query, which walks up from the different parents of the wanted rows only; these join their parent's chain once.

    ``LIMIT ALL`` lifts the session's limit of rows of a recursion; its levels end with ``max_depth``.
    """
    spark = wanted.sparkSession
    own = hierarchy.join(wanted.select("record_number"), "record_number", "left_semi")
    starts, known = f"_starts_{uuid.uuid4().hex}", f"_hierarchy_{uuid.uuid4().hex}"
    parents = hierarchy.select(F.col("parent").alias("record_number")).distinct()
    # all that a walk can come by has children
    checkpointed(hierarchy.join(parents, "record_number", "left_semi")).createOrReplaceTempView(known)
    own.select("parent").distinct().createOrReplaceTempView(starts)
    chains = spark.sql(f"""
        WITH RECURSIVE walk(start, cur, ids, names, depth) MAX RECURSION LEVEL {max_depth + 1} AS (
          SELECT h.record_number, h.parent, array(h.record_number), array(h.name), 1
          FROM {starts} s JOIN {known} h ON h.record_number = s.parent
          UNION ALL
          SELECT k.start, h.parent, array_prepend(k.ids, h.record_number), array_prepend(k.names, h.name), k.depth + 1
          FROM walk k JOIN {known} h ON h.record_number = k.cur
          WHERE k.depth < {max_depth} AND NOT array_contains(k.ids, h.record_number)
        )
        SELECT start, max_by(ids, depth) AS ids, max_by(names, depth) AS names FROM (SELECT * FROM walk LIMIT ALL) GROUP BY start""")
    return _with_own(own, chains, max_depth)


def resolve_paths(wanted: DataFrame, records: DataFrame, drive: str = "", plan: str = "auto", max_depth: int = MAX_DEPTH, max_units: int | None = MAX_UNITS) -> DataFrame:
    """``wanted`` with ``full_path``: null for the root, with ``X:\\`` in front if the drive is known."""
    hierarchy = lookup(records)
    found, kept = None, False
    # records that bring their own parent and name need no look up
    known = {"parent_record_number", "file_name"} <= set(wanted.columns)
    if plan in ("auto", "frontier"):
        # the records are read once, for what finds the wanted ones and for their ancestors
        kept = not records.is_cached
        if kept:
            records.persist(StorageLevel.MEMORY_AND_DISK)
        if plan == "frontier" or wanted.count() <= FRONTIER_ROWS:
            wanted = checkpointed(wanted)
            starts = lookup(wanted) if known else wanted.select("record_number").where(F.col("record_number") != ROOT)
            found = components_by_frontier(starts.distinct(), hierarchy, max_depth)
            found = None if found is None else checkpointed(found)
        plan = plan if found is not None else "doubling"
    if plan == "recursion":
        found = components_by_recursion(wanted.select("record_number").distinct(), hierarchy, max_depth)
    elif plan == "doubling" and known:
        if kept:  # while what was read is still there
            wanted = checkpointed(wanted)
        # only the wanted rows join their parent's chain, with all that they have
        chains = chains_by_doubling(hierarchy, max_depth).withColumnRenamed("start", "parent_record_number")
        own = F.when((F.col("record_number") != ROOT) & (F.length("file_name") > 0), _behind("file_name", max_depth))
        joined = wanted.join(chains, "parent_record_number", "left").withColumn("components", own)
        rest = [c for c in wanted.columns if c != "record_number"]
    elif plan == "doubling":
        found = components_by_doubling(hierarchy, max_depth)
    elif found is None:
        raise ValueError(f"unknown plan {plan!r}")
    if kept:
        records.unpersist()
    path = capped_path(F.col("components"), max_units)
    prefixed = F.concat(F.lit(drive + ":" + SEPARATOR), path) if drive else path
    full_path = F.when(path != "", prefixed).alias("full_path")
    if found is None:
        return joined.select("record_number", *rest, full_path)
    return wanted.join(found.select("record_number", full_path), "record_number", "left")


def managed_paths(starts: DataFrame, records: DataFrame, drive: str, max_depth: int | None = None) -> DataFrame:
    """``(record_number, path)`` without caps; every path begins with the drive, also of a record that is unknown."""
    hierarchy = lookup(records)
    found = components_by_doubling(hierarchy, max_depth)
    joined = starts.select("record_number").join(found, "record_number", "left")
    prefix = F.lit(drive + ":" + SEPARATOR)
    return joined.select("record_number", F.concat(prefix, F.coalesce(F.array_join("components", SEPARATOR), F.lit(""))).alias("path"))


def name_of_path(path: Column) -> Column:
    """What follows the last separator."""
    return F.substring_index(path, SEPARATOR, -1)
