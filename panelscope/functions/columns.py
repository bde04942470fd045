"""Column resolution from schema metadata (no Spark job)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def resolve_column(df: DataFrame, contains: str, prefer_suffix: str | None = None,
                   numeric: bool = False) -> str | None:
    """the first column whose upper-cased name contains ``contains``;
    with ``prefer_suffix`` (e.g. '_ART' after a join) a suffixed match wins;
    ``numeric`` restricts to numeric types. Returns None when nothing matches."""
    numeric_types = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    cands = [f.name for f in df.schema.fields
             if contains.upper() in f.name.upper()
             and (not numeric or f.dataType.simpleString().startswith(numeric_types))]
    if prefer_suffix:
        pref = [c for c in cands if c.upper().endswith(prefer_suffix.upper())]
        if pref:
            return pref[0]
    return cands[0] if cands else None
