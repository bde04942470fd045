"""Typed scans, optional sources and sinks."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Input contract of the tables the operators read. Parquet footers are checked
# against it (S1); extra columns are ignored by pruning.
SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "embeddings": _schema(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, typed: bool = True) -> DataFrame:
    """Lazy parquet scan; with ``typed`` the files' own schema is compared
    with the contract, and a missing column or another type raises here."""
    found = spark.read.parquet(table_path(sf_dir, name))
    if typed and name in SCHEMAS:
        types = {f.name: f.dataType for f in found.schema.fields}
        for f in SCHEMAS[name].fields:
            if f.name not in types:
                raise ValueError(f"table {name}: column {f.name} is missing")
            if types[f.name] != f.dataType:
                raise ValueError(f"table {name}: column {f.name} is {types[f.name].simpleString()}, "
                                 f"not {f.dataType.simpleString()}")
        return found.select(*SCHEMAS[name].names)
    return found


class Tables(dict):
    """Lazily scanned named tables: ``t['orders']`` builds the scan on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, typed: bool = True):
        super().__init__()
        self.spark, self.sf_dir, self.typed = spark, sf_dir, typed

    def __missing__(self, name: str) -> DataFrame:
        df = scan(self.spark, self.sf_dir, name, self.typed)
        self[name] = df
        return df


def load_tables(spark: SparkSession, sf_dir: str, typed: bool = True) -> Tables:
    """All named tables of a data folder, scanned lazily."""
    return Tables(spark, sf_dir, typed)


def table_row_counts(spark: SparkSession, sf_dir: str, names=tuple(SCHEMAS)) -> DataFrame:
    """S1 check: one row per table with its row count, as one union plan; a
    table whose columns differ from the contract raises.
    Parquet counts are answered from footers, so no data pages are read."""
    parts = [scan(spark, sf_dir, n).select(F.lit(n).alias("table_name"),
                                            F.count(F.lit(1)).alias("n_rows"))
             for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_optional(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """First existing path among candidates, else an empty typed table so
    downstream joins still resolve."""
    for p in paths:
        try:
            found = spark.read.schema(schema).parquet(p)
            _ = found.columns  # a remote session looks for the path only now
            return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def scan_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType,
                      corrupt_col: str = "_corrupt_record", header: bool = True) -> DataFrame:
    """CSV read that keeps malformed lines visible in ``corrupt_col``
    (PERMISSIVE) rather than silently dropping them."""
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType(), True)])
    return (spark.read.schema(full)
            .option("header", header).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
            .csv(path))


def csv_shape_audit(spark: SparkSession, path: str) -> DataFrame:
    """S3: number of fields per raw CSV line (quote-aware), counted per width.
    A naive comma count is wrong for quoted comma lists, so the quoted
    sections are removed before counting separators."""
    raw = spark.read.text(path)
    unquoted = F.regexp_replace(F.col("value"), r'"([^"]|"")*"', "x")
    n_fields = (F.length(unquoted) - F.length(F.regexp_replace(unquoted, ",", ""))) + 1
    return raw.groupBy(n_fields.alias("n_fields")).agg(F.count(F.lit(1)).alias("n_lines"))


def sink(df: DataFrame, path: str, partition_by: list[str] | None = None,
         mode: str = "overwrite") -> None:
    """Persist a table as Parquet, partitioned for pruning when asked."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
