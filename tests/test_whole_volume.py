from pyspark.sql import functions as F

from inodeon.plans.virtual import CUSTOMER, NATION, ORDER, REGION, read
from inodeon.queries import metadata

SMALL = "/root/testdata/sf0.001"


def test_journal_paths_of_every_parent(spark, monkeypatch):
    """Entries below orders, the largest part of the volume, have their paths too."""
    orders = read(spark, SMALL, "orders").select((F.col("o_orderkey") + ORDER).alias("parent_record_number"), F.col("o_orderkey").alias("usn"))
    monkeypatch.setattr(metadata, "journal", lambda spark, sf: orders.withColumn("file_name", F.lit("x.log")))
    got = {r.usn: r.full_path for r in metadata.QUERIES["j02_journal_full_path"](spark, SMALL).collect()}
    tables = {n: read(spark, SMALL, n).collect() for n in ("region", "nation", "customer", "orders")}
    path = {REGION + r.r_regionkey: r.r_name for r in tables["region"]}
    path |= {NATION + r.n_nationkey: path[REGION + r.n_regionkey] + "\\" + r.n_name for r in tables["nation"]}
    path |= {CUSTOMER + r.c_custkey: path[NATION + r.c_nationkey] + "\\" + r.c_name for r in tables["customer"]}
    want = {r.o_orderkey: "\\".join([path[CUSTOMER + r.o_custkey], f"Order#{r.o_orderkey}", "x.log"]) for r in tables["orders"]}
    assert got == want and len(got) > 1000
