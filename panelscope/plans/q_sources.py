"""Source / sink queries.

The file-based operators write data that Spark derives from the given
tables into a fresh folder under the session's ``spark.checkpoint.dir``
(shared storage on a cluster) and read it back, so they exercise the real
readers and writers rather than an in-memory stand-in.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.plans.registry import Ctx, register
from panelscope.session import ensure_checkpoint_dir
from panelscope.sources.tables import (csv_shape_audit, scan_csv_tolerant, scan_optional, sink,
                                       table_path)
from panelscope.sources.views import PANEL_COLUMNS

TEST = "DATE '2000-01-01'"


def _scratch(c: Ctx, name: str) -> str:
    base = ensure_checkpoint_dir(c.spark)
    return os.path.join(base, "panelscope-io", f"{name}-{uuid.uuid4().hex}")


_CRC_SCHEMA = T.StructType([T.StructField("appointment_id", T.LongType()),
                            T.StructField("client_id", T.LongType()),
                            T.StructField("appointment_duration", T.DoubleType())])


@register("scan_skip_malformed", """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE event_id % 50 = 0) AS n_malformed,
  count(*) FILTER (WHERE event_id % 50 <> 0) AS n_parsed,
  count(*) FILTER (WHERE event_id % 50 <> 0) AS n_known_duration FROM events""", ())
def scan_skip_malformed(c: Ctx):
    """Contacts written as CSV text where every 50th line carries an
    unparsable number, read back PERMISSIVE: bad lines are kept and counted
    in ``_corrupt_record`` instead of being dropped silently."""
    e = c.t["events"]
    dur = F.when(F.col("event_id") % 50 == 0, F.lit("not-a-number")).otherwise(
        F.col("value").cast("string"))
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), dur)
    path = _scratch(c, "crc-csv")
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    df = scan_csv_tolerant(c.spark, path, _CRC_SCHEMA, header=False)
    bad = F.col("_corrupt_record").isNotNull()
    # the malformed field must be among the parsed columns for the reader to
    # detect it, so the duration is referenced explicitly
    return df.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_malformed"),
                  F.count_if(~bad).alias("n_parsed"),
                  F.count("appointment_duration").alias("n_known_duration"))


@register("csv_shape_audit", f"""
SELECT {len(PANEL_COLUMNS)} AS n_fields, count(*) AS n_lines FROM panel""", ("panel",))
def csv_shape_audit_q(c: Ctx):
    """S3: the panel written as CSV (comma lists land in quoted cells), then
    the fields of every raw line counted quote-aware, per width."""
    path = _scratch(c, "panel-csv")
    c.panel.write.mode("overwrite").option("header", False).csv(path)
    return csv_shape_audit(c.spark, path).select(F.col("n_fields").cast("int").alias("n_fields"),
                                                 "n_lines")


@register("scan_optional_source", """
SELECT count(*) AS n_rows, count(DISTINCT p_partkey) AS n_ids FROM part""", ())
def scan_optional_source(c: Ctx):
    """First existing candidate path (the first one is absent), or an
    empty typed table when none exists."""
    from panelscope.sources.tables import SCHEMAS
    df = scan_optional(c.spark, ["/nonexistent/articles.parquet", table_path(c.sf_dir, "part")],
                       SCHEMAS["part"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_partkey").alias("n_ids"))


def _written_panel(c: Ctx) -> str:
    if "panel_path" not in c._cache:
        path = _scratch(c, "panel-parquet")
        sink(c.panel, path, partition_by=["date_target"])
        c._cache["panel_path"] = path
    return c._cache["panel_path"]


@register("sink_tables", """
SELECT date_target, count(*) AS n_rows, CAST(sum(nb_trs_full_hist) AS BIGINT) AS n_trs
FROM panel GROUP BY date_target""", ("panel",))
def sink_tables(c: Ctx):
    """The panel persisted as Parquet partitioned by snapshot, read back."""
    back = c.spark.read.parquet(_written_panel(c))
    return back.groupBy(F.col("date_target").cast("date").alias("date_target")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("nb_trs_full_hist").cast("bigint").alias("n_trs"))


@register("scan_precomputed_report", f"""
SELECT client_id, to_full_hist, target_1y FROM panel WHERE date_target = {TEST}""", ("panel",))
def scan_precomputed_report(c: Ctx):
    """Re-read a persisted table; the snapshot filter prunes partitions."""
    back = c.spark.read.parquet(_written_panel(c))
    return back.filter(F.col("date_target") == F.lit(c.test_snapshot)).select(
        "client_id", "to_full_hist", "target_1y")


@register("snapshot_filter", f"""
SELECT client_id, date_target, to_full_hist FROM panel WHERE date_target = {TEST}""", ("panel",))
def snapshot_filter(c: Ctx):
    """one snapshot by equality (prunes partitions on a partitioned table)."""
    return c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot)).select(
        "client_id", "date_target", "to_full_hist")


@register("missing_type_label", """
SELECT dataset, column_name, missing_type, criticality FROM (""" + "{MC}" + ") m", ())
def missing_type_label(c: Ctx):
    """(type, criticality) label per table x column."""
    from panelscope.plans.q_quality import missing_complete
    return missing_complete(c).select("dataset", "column_name", "missing_type", "criticality")


def _fix_f27_sql() -> None:
    # reuse the A14 oracle text (already with its views) inside F27's
    from panelscope.plans.registry import REGISTRY
    inner = REGISTRY["missing_complete"].sql
    q = REGISTRY["missing_type_label"]
    q.sql = ("SELECT dataset, column_name, missing_type, criticality FROM (" + inner + ") m")


_fix_f27_sql()


def _class_sql() -> str:
    from panelscope.plans.q_selection import FAMILIES, VIEWS_PROFILE
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items())
    return (VIEWS_PROFILE + f"SELECT CASE feature {case} END AS family, count(*) AS n_columns, "
            "round(avg(pct_missing), 9) AS mean_pct_missing, round(avg(pct_zero), 9) AS mean_pct_zero "
            "FROM prof GROUP BY 1")


@register("classify_columns", _class_sql(), ("master",))
def classify_columns(c: Ctx):
    """every feature mapped to its family (RFM / Articles /
    Supplementary / Aggregated), with per-family column counts and mean
    missing / zero shares measured on the train rows."""
    from panelscope.plans.q_selection import FAMILIES, _profile
    fam = F.lit(None).cast("string")
    for k, v in FAMILIES.items():
        fam = F.when(F.col("feature") == k, F.lit(v)).otherwise(fam)
    p = _profile(c)
    return p.groupBy(fam.alias("family")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.round(F.avg("pct_missing"), 9).alias("mean_pct_missing"),
        F.round(F.avg("pct_zero"), 9).alias("mean_pct_zero"))
