"""Query registry: each registered query is a Spark plan over the test tables
plus (when SQL-expressible) its DuckDB oracle text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from panelscope.plans.oracle_views import with_views
from panelscope.sources import views as V
from panelscope.sources.tables import load_tables


@dataclass
class Ctx:
    """Lazy domain views for one (session, data folder)."""
    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    @cached_property
    def t(self):
        return load_tables(self.spark, self.sf_dir)

    @cached_property
    def trs(self) -> DataFrame:
        return V.trs(self.t)

    @cached_property
    def articles(self) -> DataFrame:
        return V.articles(self.t)

    @cached_property
    def clients(self) -> DataFrame:
        return V.clients(self.t, self.trs)

    @cached_property
    def client_dimension(self) -> DataFrame:
        return V.client_dimension(self.t)

    @cached_property
    def crc(self) -> DataFrame:
        return V.crc(self.t)

    @cached_property
    def ccp(self) -> DataFrame:
        return V.ccp(self.t)

    @cached_property
    def snapshots(self) -> DataFrame:
        return V.snapshots(self.spark)

    @cached_property
    def panel(self) -> DataFrame:
        return V.panel(self.t, self.spark, self.trs, self.client_dimension)

    @cached_property
    def staged_panel(self) -> DataFrame:
        """The panel written once, for reports that read it in several jobs
        (percentile limits first, then the rows compared with them)."""
        from panelscope.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        return self.panel.checkpoint(eager=True)

    def staged(self, df: DataFrame) -> DataFrame:
        """What several jobs of a report read, written once."""
        from panelscope.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        return df.checkpoint(eager=True)

    @cached_property
    def scored(self) -> DataFrame:
        # every metric reads the scored rows in several jobs (bounds, offsets,
        # totals): materialise them once in the shared checkpoint folder
        from panelscope.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        return V.scored(self.panel).checkpoint(eager=True)

    # cleaned tables
    @cached_property
    def clean_trs(self) -> DataFrame:
        from panelscope.operators.cleaning import clean_events
        return clean_events(self.trs, V.SERIAL_PLACEHOLDER)

    @cached_property
    def clean_clients(self) -> DataFrame:
        from panelscope.operators.cleaning import clean_clients
        return clean_clients(self.clients, dt.date.fromisoformat(V.CLIENT_REFERENCE_DATE))

    @cached_property
    def clean_crc(self) -> DataFrame:
        from panelscope.operators.cleaning import clean_contacts
        return clean_contacts(self.crc)

    @cached_property
    def clean_ccp(self) -> DataFrame:
        from panelscope.operators.cleaning import clean_registrations
        return clean_registrations(self.ccp)

    @cached_property
    def clean_panel(self) -> DataFrame:
        from panelscope.operators.cleaning import clean_panel
        return clean_panel(self.panel)

    @cached_property
    def supp(self) -> DataFrame:
        from panelscope.operators.cleaning import supplementary_features
        return supplementary_features(self.clean_clients, self.clean_crc, self.clean_ccp)

    @cached_property
    def client_flags(self) -> DataFrame:
        from panelscope.operators.cleaning import client_flags
        return client_flags(self.client_dimension, self.clean_crc, self.clean_ccp)

    @property
    def snapshot_dates(self) -> list[dt.date]:
        return [dt.date.fromisoformat(d) for d in V.SNAPSHOT_DATES]

    @property
    def last_snapshot(self) -> dt.date:
        return max(dt.date.fromisoformat(d) for d in V.SNAPSHOT_DATES)

    @property
    def test_snapshot(self) -> dt.date:
        return dt.date.fromisoformat(V.TEST_SNAPSHOT)


@dataclass
class Query:
    name: str
    build: Callable[[Ctx], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register ``fn(ctx) -> DataFrame`` under ``name`` with the
    oracle ``sql`` (its CTE views are prepended automatically)."""
    def deco(fn: Callable[[Ctx], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = with_views(sql, *views) if sql is not None else None
        REGISTRY[name] = Query(name, fn, full)
        return fn
    return deco


def as_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Ctx(spark, sf_dir))
    run.__name__ = q.name
    return run
