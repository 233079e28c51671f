"""A stored index of paths, in which all below a directory is one range.

A record's key is the run of its ancestors' numbers from the top, its own last, twelve hex digits each. In the order of keys a directory is followed by all
below it, so that a subtree is a prefix, which file formats with statistics read without looking at the rest; and unlike numbers of a tour through
the forest, keys of other subtrees stay as they are when one moves. Renaming or moving directories therefore resolves their subtrees anew and
nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.functions.text import SEPARATOR
from inodeon.model import ROOT
from inodeon.operators import paths

#: Digits of a number in a key: 48 bits.
DIGITS = 12
#: Changed directories whose subtrees are found by prefixes; more are found by a join.
PREFIXES = 256
COLUMNS = ("key", "record_number", "parent_record_number", "file_name", "full_path")


def _number(record: Column) -> Column:
    return F.lpad(F.lower(F.hex(record)), DIGITS, "0")


def _resolved(hierarchy: DataFrame) -> DataFrame:
    """``(record_number, key, full_path)`` of ``(record_number, parent, name)``; both begin with what has no parent among them."""
    # a component carries its number in front of its name, so that one resolution gives both
    tagged = hierarchy.withColumn("name", F.concat(_number(F.col("record_number")), F.col("name")))
    found = paths.components_by_doubling(tagged)
    key = F.array_join(F.transform("components", lambda c: F.substring(c, 1, DIGITS)), "")
    path = paths.capped_path(F.transform("components", lambda c: F.substring(c, F.lit(DIGITS + 1), F.length(c))))
    return found.select("record_number", key.alias("key"), path.alias("full_path"))


class PathIndex:
    """The index of a volume's records in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def build(self, records: DataFrame) -> PathIndex:
        """Writes the index of all named records but the root, in the order of keys."""
        hierarchy = paths.lookup(records)
        rows = hierarchy.join(_resolved(hierarchy), "record_number")
        rows = rows.select("key", "record_number", F.col("parent").alias("parent_record_number"), F.col("name").alias("file_name"), "full_path")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(self.folder)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def below(self, record_number: int) -> DataFrame:
        """A directory and all below it."""
        own = self.rows().where(F.col("record_number") == record_number).select("key").first()
        return self.rows().where(F.col("key").startswith(own["key"] if own else "-"))

    def _touched(self, changes: DataFrame) -> DataFrame:
        """The rows of all subtrees of the changed records; the tops of at most ``PREFIXES`` subtrees are looked up as prefixes."""
        keys = self.rows().join(changes.select("record_number"), "record_number", "left_semi").select("key")
        some = sorted(r["key"] for r in keys.limit(PREFIXES + 1).collect())
        if len(some) <= PREFIXES:
            tops: list[str] = []
            for k in some:
                if not tops or not k.startswith(tops[-1]):
                    tops.append(k)
            within = F.lit(False)
            for k in tops:
                within = within | F.col("key").startswith(k)
            return self.rows().where(within)
        steps = F.transform(F.sequence(F.lit(1), (F.length("key") / DIGITS).cast("int")), lambda i: F.substring(F.col("key"), F.lit(1), i * DIGITS))
        hit = self.rows().select("record_number", F.explode(steps).alias("top")).join(keys.withColumnRenamed("key", "top"), "top", "left_semi").select("record_number").distinct()
        return self.rows().join(hit, "record_number", "left_semi")

    def renamed(self, changes: DataFrame) -> DataFrame:
        """The rows, as they are after ``changes``, of all subtrees that these touch: ``(record_number, parent_record_number, file_name)``, each record once.

        Only touched rows are resolved, within their subtrees; what they hang below is looked up.
        """
        new = changes.select("record_number", F.col("parent_record_number").alias("_parent"), F.col("file_name").alias("_name"))
        touched = self._touched(changes).select("record_number", "parent_record_number", "file_name").join(new, "record_number", "left")
        touched = paths.checkpointed(touched.select("record_number", F.coalesce("_parent", "parent_record_number").alias("parent"), F.coalesce("_name", "file_name").alias("name")))
        own = _resolved(touched)
        # the number in front of a key is that of the uppermost touched record, whose parent is outside
        tops = touched.select(_number(F.col("record_number")).alias("top"), F.col("parent").alias("outside"))
        outside = self.rows().join(tops.select(F.col("outside").alias("record_number")).distinct(), "record_number", "left_semi")
        outside = outside.select(F.col("record_number").alias("outside"), F.col("key").alias("_key"), F.col("full_path").alias("_path"))
        joined = own.withColumn("top", F.substring("key", 1, DIGITS)).join(tops, "top").join(outside, "outside", "left")
        placed = joined.select("record_number", F.concat(F.coalesce("_key", F.lit("")), "key").alias("key"), F.concat_ws(SEPARATOR, "_path", "full_path").alias("full_path"))
        return touched.join(placed, "record_number").select("key", "record_number", F.col("parent").alias("parent_record_number"), F.col("name").alias("file_name"), "full_path")

    def apply(self, changes: DataFrame, folder: str) -> PathIndex:
        """The index after the changes, in another folder."""
        after = paths.checkpointed(self.renamed(changes))
        rest = self.rows().join(after.select("record_number"), "record_number", "left_anti")
        rest.select(*COLUMNS).unionByName(after.select(*COLUMNS)).repartitionByRange("key").sortWithinPartitions("key").write.parquet(folder)
        return PathIndex(self.spark, folder)
