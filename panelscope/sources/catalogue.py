"""Expected types and roles of the views' columns, kept as field metadata.

``described`` attaches them to a view; they travel with its columns, and the
audits (F26, A15, A39, A40) choose their columns by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelscope.sources.views import PANEL_COLUMNS, VIEW_COLUMNS

_TYPES = {
    "trs": "string bigint date date string string double double bigint string string int",
    "articles": "bigint double string int int int",
    "clients": "string date string string string boolean string date date",
    # contacts: an id as text and a plain date are expected, so two columns differ
    "crc": "string string date string double",
    "ccp": "string string bigint date date boolean",
    "panel": "string date double double double double bigint bigint string string string double double double "
             "double double double bigint bigint bigint bigint double double double double bigint string string",
}
#: expected types: table -> column -> type
CONTRACTS = {t: dict(zip(VIEW_COLUMNS[t], types.split(), strict=True)) for t, types in _TYPES.items()}

# fixed values: what a panel column may be used for
ROLES = {"client_id": "TEMPORAL_ID", "date_target": "TEMPORAL_ID",
         "gender": "STATIC", "residency_country": "STATIC", "residency_market": "STATIC",
         "recency": "RISK_LEAKAGE", "all_purchased_dates": "RISK_LEAKAGE", "all_repair_pdt_categ": "RISK_LEAKAGE",
         "target_1m": "TARGET", "target_3m": "TARGET", "target_1y": "TARGET"}
PANEL_ROLES = {c: ROLES.get(c, "SAFE_FEATURE") for c in PANEL_COLUMNS}


def described(df: DataFrame, table: str) -> DataFrame:
    """``df`` with expected type and role in the metadata of its columns."""
    roles = PANEL_ROLES if table == "panel" else {}
    for f in df.schema.fields:
        known = {"expected_type": CONTRACTS[table].get(f.name), "role": roles.get(f.name)}
        df = df.withMetadata(f.name, f.metadata | {k: v for k, v in known.items() if v is not None})
    return df


def noted(df: DataFrame, what: str) -> dict[str, str]:
    """What the metadata say of each column (``role`` or ``expected_type``)."""
    return {f.name: f.metadata[what] for f in df.schema.fields if what in f.metadata}
