"""Queries of the metadata engine over the virtual volume and journal, each with its DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.functions import flags as fl
from inodeon.functions import text as tx
from inodeon.model import ATTRIBUTES, REASONS, MatchFlags, ScanProfile
from inodeon.operators import journal as jr
from inodeon.operators import match, paths, stats
from inodeon.operators.pathindex import PathIndex
from inodeon.plans.virtual import CUSTOMER, JRN_SQL, NATION, ORDER, PATHS_SQL, REGION, VOL_SQL, journal, read, volume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

V = f"WITH {VOL_SQL} "
R = f"WITH RECURSIVE {VOL_SQL}, {PATHS_SQL} "
J = f"WITH {JRN_SQL} "
FOLD = "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# scans and predicates


@query("s06_read_all", V + "SELECT record_number, parent_record_number, flags, file_name, (flags & 1) <> 0 AS in_use, (flags & 2) <> 0 AS is_directory FROM vol")
def s06(spark, sf):
    return volume(spark, sf).select("record_number", "parent_record_number", "flags", "file_name", fl.in_use("flags").alias("in_use"), fl.is_directory("flags").alias("is_directory"))


@query("r02_total_used", V + "SELECT count(*) AS total_records, count(*) FILTER (WHERE file_name LIKE '%9%') AS used_records FROM vol")
def r02(spark, sf):
    return stats.totals(volume(spark, sf), F.col("file_name").contains("9"))


@query("r03_record_order", V + "SELECT record_number, row_number() OVER (ORDER BY record_number) AS position FROM vol WHERE (flags & 2) <> 0")
def r03(spark, sf):
    return stats.positions(volume(spark, sf).where(fl.is_directory("flags")).select("record_number"), "record_number")


@query("p07_flags", V + "SELECT flags, (flags & 1) <> 0 AS in_use, (flags & 2) <> 0 AS is_directory, count(*) AS n FROM vol GROUP BY flags")
def p07(spark, sf):
    return volume(spark, sf).groupBy("flags", fl.in_use("flags").alias("in_use"), fl.is_directory("flags").alias("is_directory")).agg(F.count("*").alias("n"))


@query("p08_exact_ci", V + f"SELECT record_number, file_name FROM vol WHERE {FOLD} = 'order#42'")
def p08(spark, sf):
    return match.find_by_name(volume(spark, sf), "ORDER#42").select("record_number", "file_name")


@query("p09_contains_ci", V + f"SELECT record_number, file_name FROM vol WHERE contains({FOLD}, 'er#1')")
def p09(spark, sf):
    return match.find_by_name(volume(spark, sf), "ER#1", MatchFlags.CONTAINS).select("record_number", "file_name")


@query("p09_contains_parts", "SELECT p_partkey, p_name FROM part WHERE contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 're')")
def p09_parts(spark, sf):
    return read(spark, sf, "part").where(match.name_predicate(F.col("p_name"), "RE", MatchFlags.CONTAINS)).select("p_partkey", "p_name")


@query("p09_contains_pages", "SELECT page_id, url FROM pages WHERE contains(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'example.org')")
def p09_pages(spark, sf):
    return read(spark, sf, "pages").where(match.name_predicate(F.col("url"), "Example.ORG", MatchFlags.CONTAINS)).select("page_id", "url")


@query("p09_empty_needle", V + "SELECT count(*) AS n FROM vol")
def p09_empty(spark, sf):
    return match.find_by_name(volume(spark, sf), "", MatchFlags.CONTAINS).agg(F.count("*").alias("n"))


@query("p10_exact_precedence", V + f"SELECT record_number, file_name FROM vol WHERE {FOLD} = 'order#1'")
def p10(spark, sf):
    return match.find_by_name(volume(spark, sf), "order#1", MatchFlags.EXACT | MatchFlags.CONTAINS).select("record_number", "file_name")


@query("p10_no_bits_empty", V + "SELECT record_number, file_name FROM vol WHERE false")
def p10_none(spark, sf):
    return match.find_by_name(volume(spark, sf), "order#1", MatchFlags.NONE).select("record_number", "file_name")


@query("p10_no_text_all", V + "SELECT count(*) AS n, sum(record_number)::BIGINT AS checksum FROM vol")
def p10_all(spark, sf):
    return match.find_by_name(volume(spark, sf), None, MatchFlags.NONE).agg(F.count("*").alias("n"), F.sum("record_number").alias("checksum"))


@query("p12_find_by_name_paths", R + f"SELECT v.record_number, v.file_name, p.path AS full_path FROM vol v JOIN paths p USING (record_number) WHERE contains({FOLD.replace('file_name', 'v.file_name')}, '#77')")
def p12(spark, sf):
    return match.find_by_name(volume(spark, sf), "#77", MatchFlags.CONTAINS | MatchFlags.RESOLVE_PATHS).select("record_number", "file_name", "full_path")


FIND = R + f"SELECT v.record_number, coalesce(p.path, v.file_name) AS path FROM vol v LEFT JOIN paths p USING (record_number) WHERE {FOLD.replace('file_name', 'v.file_name')} = "


@query("p13_find_any", FIND + "'order#7'")
def p13(spark, sf):
    return match.find_records(volume(spark, sf), "Order#7")


@query("p14_find_dirs", FIND + "'nation_7' AND (v.flags & 2) <> 0")
def p14_dirs(spark, sf):
    return match.find_directories(volume(spark, sf), "Nation_7")


@query("p14_find_files", FIND + "'order#100' AND (v.flags & 2) = 0")
def p14_files(spark, sf):
    return match.find_files(volume(spark, sf), "ORDER#100")


@query("p06_reference_strip", "SELECT o_orderkey, o_custkey::BIGINT AS record_number FROM orders")
def p06(spark, sf):
    """Record numbers of references whose high 16 bits count how often a slot was used."""
    reference = F.shiftleft((F.col("o_orderkey") % 32768).cast("long"), 48).bitwiseOR(F.col("o_custkey").cast("long"))
    return read(spark, sf, "orders").select("o_orderkey", fl.record_of(reference).alias("record_number"))


@query("p15_cli_search", V + f"SELECT record_number, file_name FROM vol WHERE length(file_name) > 0 AND contains({FOLD}, 'tion_1')")
def p15(spark, sf):
    return match.find_by_name(volume(spark, sf).where(F.length("file_name") > 0), "TION_1", MatchFlags.CONTAINS).select("record_number", "file_name")


@query("p16_first_names", V + "SELECT record_number, file_name FROM vol WHERE length(file_name) > 0 ORDER BY record_number LIMIT 25")
def p16(spark, sf):
    return match.first_names(volume(spark, sf))


@query("p17_scanner", R + f"SELECT v.record_number, p.path AS full_path FROM vol v JOIN paths p USING (record_number) WHERE contains({FOLD.replace('file_name', 'v.file_name')}, '99')")
def p17(spark, sf):
    """The flagship: a substring search with full paths."""
    return match.find_by_name(volume(spark, sf), "99", MatchFlags.CONTAINS | MatchFlags.RESOLVE_PATHS).select("record_number", "full_path")


@query("p18_directory_index", V + "SELECT record_number, file_name FROM vol WHERE (flags & 2) <> 0 OR upper(file_name) IN ('ORDER#1', 'ORDER#33')")
def p18(spark, sf):
    rows = volume(spark, sf).withColumn("is_directory", fl.is_directory("flags"))
    return match.keep_profile(rows, ScanProfile.DIRECTORY_INDEX, ["order#1", "Order#33"]).select("record_number", "file_name")


@query("p18_keep_join", V + "SELECT record_number, file_name FROM vol WHERE (flags & 2) <> 0 OR upper(file_name) IN (SELECT 'ORDER#' || i::VARCHAR FROM range(1, 401) t(i))")
def p18_join(spark, sf):
    rows = volume(spark, sf).withColumn("is_directory", fl.is_directory("flags"))
    return match.keep_profile(rows, ScanProfile.DIRECTORY_INDEX, [f"order#{i}" for i in range(1, 401)]).select("record_number", "file_name")


@query("p18_full_profile", V + "SELECT count(*) AS n FROM vol")
def p18_full(spark, sf):
    rows = volume(spark, sf).withColumn("is_directory", fl.is_directory("flags"))
    return match.keep_profile(rows, ScanProfile.FULL, ["ignored"]).agg(F.count("*").alias("n"))


@query("p19_inventory", R + "SELECT v.record_number, v.parent_record_number, 0::BIGINT AS size, 0::BIGINT AS last_write_ticks, v.file_attributes AS attributes, (v.flags & 2) <> 0 AS is_directory, v.file_name AS name, p.path FROM vol v JOIN paths p USING (record_number) WHERE (v.flags & 1) <> 0 AND p.path <> ''")
def p19(spark, sf):
    rows = volume(spark, sf)
    return match.inventory(paths.resolve_paths(rows, rows, plan="doubling")).withColumn("size", F.col("size").cast("long"))


@query("p20_attr_decode", V + "SELECT record_number, " + " || ".join(f"CASE WHEN (file_attributes + record_number % 8) & {b} <> 0 THEN '{n},' ELSE '' END" for n, b in ATTRIBUTES.items()) + " AS names FROM vol")
def p20(spark, sf):
    names = fl.attribute_names(F.col("file_attributes") + F.col("record_number") % 8)
    return volume(spark, sf).select("record_number", F.array_join(F.transform(names, lambda x: F.concat(x, F.lit(","))), "").alias("names"))


@query("p21_display_name", R + "SELECT v.record_number, coalesce(p.path, v.file_name) AS shown FROM vol v LEFT JOIN paths p USING (record_number) WHERE (v.flags & 2) <> 0")
def p21(spark, sf):
    rows = volume(spark, sf)
    found = paths.resolve_paths(rows.where(fl.is_directory("flags")), rows)
    return found.select("record_number", F.coalesce("full_path", "file_name").alias("shown"))


# hierarchy


@query("h02_paths_full", R + "SELECT record_number, path AS full_path FROM paths")
def h02(spark, sf):
    rows = volume(spark, sf)
    return paths.resolve_paths(rows.where("record_number <> 5"), rows, plan="doubling").select("record_number", "full_path")


@query("h02_paths_filtered", R + f"SELECT v.record_number, p.path AS full_path FROM vol v JOIN paths p USING (record_number) WHERE contains({FOLD.replace('file_name', 'v.file_name')}, '7')")
def h02_filtered(spark, sf):
    """The paths of what a name search finds, walked up from there."""
    rows = volume(spark, sf)
    found = match.find_by_name(rows, "7", MatchFlags.CONTAINS)
    return paths.resolve_paths(found, rows, plan="frontier").select("record_number", "full_path")


@query("h02_paths_recursive", R + "SELECT record_number, path AS full_path FROM paths")
def h02_recursive(spark, sf):
    rows = volume(spark, sf)
    return paths.resolve_paths(rows.where("record_number <> 5"), rows, plan="recursion").select("record_number", "full_path")


@query("h04_managed_prefix", R + "SELECT record_number, 'C:' || chr(92) || path AS path FROM paths UNION ALL SELECT 5::BIGINT, 'C:' || chr(92) UNION ALL SELECT 999::BIGINT, 'C:' || chr(92)")
def h04(spark, sf):
    rows = volume(spark, sf)
    starts = rows.select("record_number").unionByName(spark.range(999, 1000).withColumnRenamed("id", "record_number"))
    return paths.managed_paths(starts, rows, "C")


@query("h05_null_root", R + "SELECT v.record_number, CASE WHEN p.path IS NOT NULL THEN 'D:' || chr(92) || p.path END AS full_path FROM vol v LEFT JOIN paths p USING (record_number)")
def h05(spark, sf):
    rows = volume(spark, sf)
    return paths.resolve_paths(rows, rows, drive="D", plan="doubling").select("record_number", "full_path")


@query("h06_name_from_path", R + "SELECT record_number, regexp_extract(path, '[^' || chr(92) || chr(92) || ']*$') AS name FROM paths")
def h06(spark, sf):
    rows = volume(spark, sf)
    found = paths.resolve_paths(rows.where("record_number <> 5"), rows, plan="doubling")
    return found.select("record_number", paths.name_of_path(F.col("full_path")).alias("name"))


#: Directories whose names change (nations) and that move below another one (some customers), in Spark and in SQL.
MOVED_SQL = f"""changed AS (
  SELECT ({NATION} + n_nationkey)::BIGINT AS record_number, ({REGION} + n_regionkey)::BIGINT AS parent, n_name || ' (old)' AS name FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT ({CUSTOMER} + c_custkey)::BIGINT, ({NATION} + (c_nationkey + 1) % 25)::BIGINT, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5
), moved AS (
  SELECT v.record_number, coalesce(c.parent, v.parent_record_number) AS parent, coalesce(c.name, v.file_name) AS name, v.parent_record_number AS old_parent, c.record_number IS NOT NULL AS top FROM vol v LEFT JOIN changed c USING (record_number)
), old AS (
  SELECT record_number, top AS hit FROM moved WHERE old_parent = 5 AND record_number <> 5
  UNION ALL SELECT m.record_number, o.hit OR m.top FROM moved m JOIN old o ON m.old_parent = o.record_number
), again AS (
  SELECT record_number, name AS path FROM moved WHERE parent = 5 AND record_number <> 5
  UNION ALL SELECT m.record_number, a.path || chr(92) || m.name FROM moved m JOIN again a ON m.parent = a.record_number
)"""


def _changes(spark, sf):
    nations, customers = read(spark, sf, "nation"), read(spark, sf, "customer")
    c = F.col
    renamed = nations.where("n_regionkey = 1").select((c("n_nationkey") + NATION).cast("long").alias("record_number"), (c("n_regionkey") + REGION).cast("long").alias("parent_record_number"), F.concat("n_name", F.lit(" (old)")).alias("file_name"))
    moved = customers.where("c_mktsegment = 'BUILDING' and c_nationkey < 5")
    return renamed.unionByName(moved.select((c("c_custkey") + CUSTOMER).cast("long").alias("record_number"), ((c("c_nationkey") + 1) % 25 + NATION).cast("long").alias("parent_record_number"), c("c_name").alias("file_name")))


def _index(spark, sf):
    return PathIndex(spark, f"{paths.shared_folder(spark)}/path-index-{uuid.uuid4().hex}").build(volume(spark, sf))


@query("h02_renamed_subtrees", f"WITH RECURSIVE {VOL_SQL}, {MOVED_SQL} SELECT record_number, path AS full_path FROM again JOIN old USING (record_number) WHERE hit")
def h02_renamed(spark, sf):
    """The paths of all below directories that were renamed or moved; only these subtrees are resolved anew."""
    return _index(spark, sf).renamed(_changes(spark, sf)).select("record_number", "full_path")


@query("h02_subtree_range", f"WITH RECURSIVE {VOL_SQL}, {MOVED_SQL} SELECT record_number, path AS full_path FROM again WHERE path = 'AMERICA' OR starts_with(path, 'AMERICA' || chr(92))")
def h02_subtree(spark, sf):
    """All below one region after the changes, as a range of the index."""
    after = _index(spark, sf).apply(_changes(spark, sf), f"{paths.shared_folder(spark)}/path-index-{uuid.uuid4().hex}")
    region = read(spark, sf, "region").where("r_name = 'AMERICA'").select("r_regionkey").first()[0]
    return after.below(REGION + region).select("record_number", "full_path")


@query(
    "h02_cycle_orphan",
    f"""WITH RECURSIVE f AS (
      SELECT ({CUSTOMER} + c_custkey)::BIGINT AS r, ({CUSTOMER} + c_custkey // 5 * 5 + (c_custkey + 1) % 5)::BIGINT AS p, c_name AS n FROM customer
      UNION ALL SELECT ({ORDER} + o_orderkey)::BIGINT,
        (CASE o_orderkey % 7 WHEN 0 THEN {9 * ORDER} + o_orderkey WHEN 1 THEN {ORDER} + o_orderkey WHEN 2 THEN 5 ELSE {CUSTOMER} + o_custkey END)::BIGINT, 'Order#' || o_orderkey::VARCHAR FROM orders
      UNION ALL SELECT 5::BIGINT, 5::BIGINT, '.'
    ), walk AS (
      SELECT r AS s, p AS cur, [r] AS ids, n AS path, 1 AS d FROM f WHERE r <> 5
      UNION ALL
      SELECT w.s, f.p, list_append(w.ids, f.r), f.n || chr(92) || w.path, w.d + 1 FROM walk w JOIN f ON f.r = w.cur
      WHERE f.r <> 5 AND NOT list_contains(w.ids, f.r)
    )
    SELECT s AS record_number, arg_max(path, d) AS full_path FROM walk GROUP BY s UNION ALL SELECT 5::BIGINT, NULL""",
)
def h02_cycle(spark, sf):
    """Customers that are each other's parents in rounds of five, with orders below them; other orders' parents are missing, themselves, or the root."""
    c, number = F.col, F.lit(1).cast("long")
    customers = read(spark, sf, "customer").select((c("c_custkey") + CUSTOMER * number).alias("record_number"), (F.expr("c_custkey div 5 * 5 + (c_custkey + 1) % 5") + CUSTOMER * number).alias("parent_record_number"), c("c_name").alias("file_name"))
    kind, own = c("o_orderkey") % 7, c("o_orderkey") + ORDER * number
    parent = F.when(kind == 0, c("o_orderkey") + 9 * ORDER * number).when(kind == 1, own).when(kind == 2, F.lit(5)).otherwise(c("o_custkey") + CUSTOMER * number)
    orders = read(spark, sf, "orders").select(own.alias("record_number"), parent.alias("parent_record_number"), F.concat(F.lit("Order#"), c("o_orderkey").cast("string")).alias("file_name"))
    root = spark.range(5, 6).select(c("id").alias("record_number"), c("id").alias("parent_record_number"), F.lit(".").alias("file_name"))
    rows = customers.unionByName(orders).unionByName(root)
    return paths.resolve_paths(rows, rows, plan="doubling").select("record_number", "full_path")


# journal scalars and reads


@query("u01_reason_flags", J + "SELECT usn, (reason & 256) <> 0 AS is_create, (reason & 512) <> 0 AS is_delete, (reason & 12288) <> 0 AS is_rename, (reason & 2147483648) <> 0 AS is_close FROM jrn")
def u01(spark, sf):
    return jr.with_reason_flags(journal(spark, sf)).select("usn", "is_create", "is_delete", "is_rename", "is_close")


@query(
    "u02_reason_text",
    J + "SELECT usn, '[' || CASE WHEN reason = 0 THEN 'None' ELSE list_aggregate(list_filter([" + ", ".join(f"CASE WHEN reason & {b} <> 0 THEN '{n}' END" for n, b in REASONS.items()) + "], lambda x: x IS NOT NULL), 'string_agg', ', ') END || '] ' || file_name || ' (record ' || record_number::VARCHAR || ')' AS shown FROM jrn",
)
def u02(spark, sf):
    return journal(spark, sf).select("usn", fl.entry_text("reason", "file_name", "record_number").alias("shown"))


@query("u03_filetime", J + "SELECT usn, epoch_us(ts) * 10 + 116444736000000000 AS filetime, epoch_us(ts) AS micros, CASE WHEN usn % 100 = 0 THEN -62135596800000000 ELSE epoch_us(ts) END AS shown_micros FROM jrn")
def u03(spark, sf):
    filetime = fl.timestamp_to_filetime(F.col("ts").cast("timestamp"))
    rows = journal(spark, sf).select("usn", filetime.alias("filetime"))
    shown = fl.filetime_to_timestamp(F.when(F.col("usn") % 100 == 0, F.lit(0).cast("long")).otherwise(F.col("filetime") + 7))
    return rows.select("usn", "filetime", F.unix_micros(fl.filetime_to_timestamp("filetime")).alias("micros"), F.unix_micros(shown).alias("shown_micros"))


@query("u05_read_since_cursor", J + "SELECT usn, record_number, reason FROM jrn WHERE usn >= (SELECT max(usn) // 2 FROM jrn)")
def u05(spark, sf):
    entries = journal(spark, sf)
    start = entries.agg(F.expr("max(usn) div 2")).first()[0]
    return jr.read_since(entries, start).select("usn", "record_number", "reason")


@query("u05_next_cursor", J + "SELECT record_number % 25 AS drive, max(usn) + 1 AS next_usn FROM jrn GROUP BY 1")
def u05_next(spark, sf):
    return jr.next_cursor(journal(spark, sf).withColumn("drive", F.col("record_number") % 25), "drive")


@query("u08_batches_with_cursor", J + "SELECT usn // 1000 AS batch, count(*) AS n_entries, max(usn) + 1 AS next_usn FROM jrn GROUP BY 1")
def u08(spark, sf):
    return jr.batches_with_cursor(journal(spark, sf), 1000)


@query("u10_arm_scan_catchup", f"WITH {VOL_SQL}, {JRN_SQL}, b AS (SELECT max(usn) // 3 AS armed, max(usn) - max(usn) // 3 AS latest FROM jrn), c AS (SELECT record_number, count(*) AS n, max(usn) AS last_usn FROM jrn, b WHERE usn >= armed AND usn < latest GROUP BY 1) SELECT v.record_number, coalesce(c.n, 0) AS n_changes, c.last_usn FROM vol v LEFT JOIN c USING (record_number)")
def u10(spark, sf):
    entries = journal(spark, sf)
    top = entries.agg(F.max("usn")).first()[0]
    return jr.snapshot_with_catch_up(volume(spark, sf), entries, top // 3, top - top // 3).select("record_number", "n_changes", "last_usn")


@query("a09_latest_changes", J + "SELECT record_number, usn, reason, file_name FROM jrn QUALIFY row_number() OVER (PARTITION BY record_number ORDER BY usn DESC) = 1")
def a09(spark, sf):
    return jr.latest_changes(journal(spark, sf).select("usn", "record_number", "reason", "file_name")).select("record_number", "usn", "reason", "file_name")


@query("a09_apply_changes", f"WITH {VOL_SQL}, {JRN_SQL}, l AS (SELECT * FROM jrn QUALIFY row_number() OVER (PARTITION BY record_number ORDER BY usn DESC) = 1) SELECT coalesce(v.record_number, l.record_number) AS record_number, coalesce(l.file_name, v.file_name) AS file_name, coalesce(l.parent_record_number, v.parent_record_number) AS parent_record_number FROM vol v FULL JOIN l ON v.record_number = l.record_number WHERE coalesce((l.reason & 512) = 0, true)")
def a09_apply(spark, sf):
    out = jr.apply_changes(volume(spark, sf), journal(spark, sf))
    return out.select("record_number", "file_name", "parent_record_number")


# joins


@query("j01_scan_join_journal", f"WITH {VOL_SQL}, {JRN_SQL} SELECT v.record_number, v.file_name, j.usn, j.reason FROM vol v JOIN jrn j USING (record_number)")
def j01(spark, sf):
    return volume(spark, sf).select("record_number", "file_name").join(journal(spark, sf).select("record_number", "usn", "reason"), "record_number")


@query("j01_untouched_anti", f"WITH {VOL_SQL}, {JRN_SQL} SELECT record_number, file_name FROM vol v WHERE NOT EXISTS (SELECT 1 FROM jrn j WHERE j.record_number = v.record_number)")
def j01_anti(spark, sf):
    return volume(spark, sf).select("record_number", "file_name").join(journal(spark, sf).select("record_number"), "record_number", "left_anti")


@query("j02_journal_full_path", f"WITH RECURSIVE {VOL_SQL}, {PATHS_SQL}, {JRN_SQL} SELECT j.usn, p.path || chr(92) || j.file_name AS full_path FROM jrn j JOIN paths p ON j.parent_record_number = p.record_number")
def j02(spark, sf):
    rows, entries = volume(spark, sf), journal(spark, sf)
    parents = entries.select(F.col("parent_record_number").alias("record_number")).distinct()
    found = paths.resolve_paths(rows.join(parents, "record_number", "left_semi"), rows).select("record_number", "full_path")
    return jr.with_full_path(entries, found).select("usn", "full_path")


@query("j03_frame_to_drive", "SELECT c_custkey, n_name AS drive FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j03(spark, sf):
    """Rows to the drive of their shared map, a lookup in a table of 25 names."""
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("drive"))
    return read(spark, sf, "customer").join(names, "c_nationkey").select("c_custkey", "drive")


@query("j04_parent_join", V + "SELECT c.record_number, c.file_name, p.file_name AS parent_name FROM vol c LEFT JOIN vol p ON p.record_number = c.parent_record_number WHERE c.record_number <> 5")
def j04(spark, sf):
    """One level of the hierarchy: records with their parent's name."""
    rows = volume(spark, sf)
    parents = rows.select(F.col("record_number").alias("parent_record_number"), F.col("file_name").alias("parent_name"))
    return rows.where("record_number <> 5").join(parents, "parent_record_number", "left").select("record_number", "file_name", "parent_name")


@query("j05_keep_semi", V + "SELECT record_number, file_name FROM vol WHERE upper(file_name) IN (SELECT upper(n_name) FROM nation)")
def j05(spark, sf):
    keep = read(spark, sf, "nation").select(F.upper("n_name").alias("k"))
    rows = volume(spark, sf)
    return rows.join(keep, F.upper(rows["file_name"]) == keep["k"], "left_semi").select("record_number", "file_name")


@query("j06_unique_index", f"WITH {VOL_SQL}, {JRN_SQL} SELECT record_number, count(*) AS n FROM jrn GROUP BY 1 HAVING count(*) > 1")
def j06(spark, sf):
    return match.repeated_numbers(journal(spark, sf))


# aggregates


@query("a01_counts", V + "SELECT count(*) AS total, count(*) FILTER (WHERE (flags & 2) <> 0) AS directories, count(*) FILTER (WHERE contains(file_name, '42')) AS matched FROM vol")
def a01(spark, sf):
    return volume(spark, sf).agg(F.count("*").alias("total"), F.count_if(fl.is_directory("flags")).alias("directories"), F.count_if(F.col("file_name").contains("42")).alias("matched"))


@query("a02_upper_median", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY event_type")
def a02(spark, sf):
    return stats.upper_median(read(spark, sf, "events"), ["event_type"], "value", "median")


@query("a03_throughput", "SELECT l_suppkey, count(*) AS records, sum(l_linenumber)::BIGINT AS millis, count(*) / (sum(l_linenumber) / 1000.0::DOUBLE) AS per_second FROM lineitem GROUP BY l_suppkey")
def a03(spark, sf):
    sums = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("records"), F.sum("l_linenumber").alias("millis"))
    return sums.withColumn("per_second", stats.throughput(F.col("records"), F.col("millis")))


@query("k06_report", "SELECT l_suppkey::VARCHAR || ': ' || count(*)::VARCHAR || ' records in ' || sum(l_linenumber)::VARCHAR || ' ms, ' || floor(count(*) / (sum(l_linenumber) / 1000.0::DOUBLE))::BIGINT::VARCHAR || ' rec/s' AS line FROM lineitem GROUP BY l_suppkey")
def k06(spark, sf):
    sums = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("records"), F.sum("l_linenumber").alias("millis"))
    return stats.report(sums, "l_suppkey", "records", "millis")


@query("u04_create_entries", "SELECT 'C' AS drive, 0::DECIMAL(20,0) AS journal_id, o_custkey::BIGINT AS record_number, 0::BIGINT AS parent_record_number, o_orderkey::BIGINT AS usn, 0::BIGINT AS filetime, CASE WHEN o_orderkey % 2 = 0 THEN 256 ELSE 0 END::BIGINT AS reason, 0::BIGINT AS file_attributes, 'Order#' || o_orderkey::VARCHAR AS file_name FROM orders")
def u04(spark, sf):
    """Entries from decoded values; the reference has sequence bits, and half the reasons are missing."""
    reference = F.shiftleft((F.col("o_orderkey") % 32768).cast("long"), 48).bitwiseOR(F.col("o_custkey").cast("long"))
    name = F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
    return jr.create_entries(read(spark, sf, "orders"), drive=F.lit("C"), record_number=reference, usn="o_orderkey", reason=F.when(F.col("o_orderkey") % 2 == 0, 256), file_name=name)


@query("a04_combine_timers", "SELECT o_custkey, sum(n)::BIGINT AS io_ms, max(m)::BIGINT AS fixup_ms, (max(e) - max(m))::BIGINT AS parse_ms FROM (SELECT o_custkey, o_orderkey % 97 AS n, o_orderkey % 13 AS m, o_orderkey % 101 + 13 AS e FROM orders) GROUP BY o_custkey")
def a04(spark, sf):
    rows = read(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey % 97 as io_ms", "o_orderkey % 13 as fixup_ms", "o_orderkey % 101 + 13 as elapsed_ms")
    return stats.combine_timers(rows, "o_custkey")


@query("a05_run_bytes", "SELECT l_orderkey, sum(l_linenumber * 4096)::BIGINT AS bytes, (sum(l_linenumber * 4096) // 1024)::BIGINT AS records FROM lineitem GROUP BY l_orderkey")
def a05(spark, sf):
    """Bytes of a table's data runs, and the records that they hold; an order stands for a table, its lines for the runs."""
    runs = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("clusters"))
    return stats.run_bytes(runs, "clusters", 4096, 1024, "l_orderkey")


@query("a06_distinct_numbers", J + "SELECT count(*) AS n_rows, count(DISTINCT record_number) AS n_records FROM jrn")
def a06(spark, sf):
    return journal(spark, sf).agg(F.count("*").alias("n_rows"), F.count_distinct("record_number").alias("n_records"))


@query("a07_multi_drive_fold", "SELECT c_nationkey AS drive, arg_max(c_name, c_custkey) AS name, max(c_custkey) AS seq FROM customer GROUP BY c_nationkey")
def a07(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_nationkey").alias("drive"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    return jr.fold_responses(rows).select("drive", "name", "seq")


@query("a07_union_drives", f"SELECT 'D' || (n_nationkey % 3)::VARCHAR AS drive, count(*) AS n, min({NATION} + n_nationkey)::BIGINT AS first FROM nation GROUP BY 1")
def a07_union(spark, sf):
    parts = [read(spark, sf, "nation").where(F.col("n_nationkey") % 3 == i).withColumn("drive", F.lit(f"D{i}")) for i in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("drive").agg(F.count("*").alias("n"), (F.min("n_nationkey") + NATION).cast("long").alias("first"))


@query("a08_ordered_distinct", J + "SELECT record_number, reason, row_number() OVER (PARTITION BY record_number ORDER BY a, reason) AS position FROM (SELECT record_number, reason, min(usn) AS a FROM jrn GROUP BY 1, 2)")
def a08(spark, sf):
    return jr.ordered_distinct(journal(spark, sf), "record_number", "reason", "usn")


# text grammars

LETTER = "chr((65 + c_custkey % 26)::INTEGER)"


@query("s02_volume_path", f"SELECT c_custkey, chr(92) || chr(92) || '.' || chr(92) || {LETTER} || ':' AS path FROM customer")
def s02(spark, sf):
    letter = F.char((F.lit(65) + F.col("c_custkey") % 26).cast("int"))
    spelled = F.concat(letter, F.element_at(F.array(F.lit(""), F.lit(":"), F.lit(":\\")), (F.col("c_custkey") % 3 + 1).cast("int")))
    device = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("\\\\.\\"), letter, F.lit(":"))).otherwise(spelled)
    return read(spark, sf, "customer").select("c_custkey", tx.volume_path(device).alias("path"))


@query("s03_drive_letter", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {LETTER} ELSE '' END AS letter FROM customer")
def s03(spark, sf):
    letter = F.char((F.lit(65) + F.col("c_custkey") % 26).cast("int"))
    device = F.concat(F.lit("\\\\.\\"), letter, F.lit(":"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("\\"))
    return read(spark, sf, "customer").select("c_custkey", tx.drive_letter(device).alias("letter"))


@query("u20_normalise", "SELECT n_nationkey, upper(n_name) AS drive FROM nation")
def u20(spark, sf):
    tail = F.element_at(F.array(F.lit(""), F.lit(":"), F.lit(":\\"), F.lit("/")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf, "nation").select("n_nationkey", tx.normal_drive(F.concat(F.lower("n_name"), tail)).alias("drive"))


@query("c03_drive_spec_parse", f"SELECT c_nationkey, {LETTER} AS letter, c_custkey::BIGINT AS journal_id, (c_custkey * 8)::BIGINT AS next_usn, CASE WHEN c_custkey % 2 = 0 THEN 'map' || c_custkey::VARCHAR END AS map_name, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS profile FROM customer")
def c03(spark, sf):
    key = F.col("c_custkey")
    one = tx.drive_spec_text(
        F.char((F.lit(65) + key % 26).cast("int")), key, key * 8, F.when(key % 2 == 0, F.concat(F.lit("map"), key.cast("string"))), F.when(key % 4 == 0, F.lit(1))
    )
    text = F.concat(one, F.when(key % 3 == 0, ", ").otherwise(""))
    specs = read(spark, sf, "customer").select("c_nationkey", text.alias("spec")).withColumn("d", F.explode(tx.drive_specs("spec")))
    return specs.select("c_nationkey", "d.letter", F.col("d.journal_id").cast("long").alias("journal_id"), "d.next_usn", "d.map_name", "d.profile")


@query("c05_quoted_arguments", "SELECT n_regionkey, list_aggregate(list_sort(list('\"' || n_name || '\"')), 'string_agg', ' ') AS arguments FROM nation GROUP BY n_regionkey")
def c05(spark, sf):
    names = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", tx.quoted_arguments("names").alias("arguments"))


@query("k02_payload_size", R + "SELECT (28 + 56 * count(*) + 2 * sum(length(v.file_name) + length(p.path)))::BIGINT AS bytes FROM vol v JOIN paths p USING (record_number)")
def k02(spark, sf):
    rows = volume(spark, sf)
    return stats.payload_size(match.inventory(paths.resolve_paths(rows, rows, plan="doubling")))


