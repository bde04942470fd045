"""panelscope: Spark-native audits, cleaning, as-of features and spend-model
scoring for client panels.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing iterates over rows on the driver.
"""

from panelscope.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
