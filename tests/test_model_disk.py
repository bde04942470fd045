"""What the model queries leave on disk while they go on."""

import datetime as dt
import glob
import os

from panelscope.plans import q_model as QM
from panelscope.plans.registry import Ctx
from panelscope.session import ensure_checkpoint_dir, forget, stored


def tables(spark, folder):
    """40 clients with an order of one line each year but one in three, in the year's
    first month (so that targets differ), and a few contacts."""
    day = lambda y, i: dt.datetime(y, 1 + i % 5, 1 + i % 28)
    orders = [(100 * i + y - 1990, i, "O", 100.0 * i, day(y, i), "1-URGENT")
              for i in range(1, 41) for y in range(1993, 2002) if (i + y) % 3]
    parts = [(i, f"part {i}", f"Brand#{i % 5}", f"TYPE {i % 7}", i % 50, 900.0 + i) for i in range(1, 21)]
    made = {
        "region": ("r_regionkey int, r_name string", [(0, "EUROPE"), (1, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 2) for i in range(5)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(i, f"c{i}", i % 5, 10.0 * i - 100, ("BUILDING", "MACHINERY", "OTHER")[i % 3]) for i in range(1, 41)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "s1", 0, 5.0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", parts),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                   "o_orderpriority string", orders),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                     "l_shipdate timestamp_ntz",
                     [(o[0], 1 + o[0] % 20, 1, 1, float(1 + o[0] % 50), 10.0 + o[0] % 900, 0.0, 0.0, "NAR"[o[0] % 3], "F", o[4])
                      for o in orders]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
                   [(i, day(1996, i), 1 + i % 40, ("view", "purchase", "error")[i % 3], 5.0 * i, "{}") for i in range(60)])}
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def files(spark, kind):
    if kind == "shuffle":
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {x for f in folders for x in glob.glob(f"{f}/**/shuffle_*.data", recursive=True)}
    return set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/{kind}-*"))


def test_models_keep_only_what_they_read(spark, tmp_path):
    """Train and test as they are fitted are all that stays of the master and the
    selection; the master's parts and the stored selection are deleted."""
    before = {k: files(spark, k) for k in ("stored", "selection")}
    c = Ctx(spark, tables(spark, tmp_path))
    train, test, *_ = QM._prepared(c)
    left = {k: {x for x in files(spark, k) - before[k] if glob.glob(f"{x}/**/part-*", recursive=True)} for k in before}
    assert {os.path.basename(x) for x in left["stored"]} == {os.path.basename(df.stored_in) for df in (train, test)}
    assert all(not glob.glob(f"{x}/t*") for x in left["selection"])  # the drop list alone stays
    assert test.count() == 40 and train.count() > 100
    assert QM.fit_logistic(c).count() == 40


def test_stored_tables_are_read_as_they_were(spark):
    df = spark.sql("SELECT id, CAST(id AS DECIMAL(20, 2)) AS d, TIMESTAMP_NTZ'2001-02-03 04:05:06' AS t, "
                   "array(id, NULL) AS a FROM range(5) UNION ALL SELECT NULL, NULL, NULL, NULL")
    got = stored(df.repartition(3, "id"))
    assert got.dtypes == df.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    forget(got)
    assert not os.path.exists(got.stored_in.removeprefix("file:"))
