"""civicframe: Spark DataFrame operators and ready-made plans for housing,
census, service-request and time-stamped activity analysis.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
built from Spark's own column functions, so Catalyst can push filters and
projections into the scan and whole-stage codegen can fuse the expressions.
"""

from civicframe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
