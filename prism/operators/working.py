"""Working sets of multi-pass operators.

Exact quantiles, correlation and k-means read their (projected, cleaned) input
several times. The projection is persisted once (MEMORY_AND_DISK: a lost
executor only recomputes its blocks from lineage). The cache is released when the
result DataFrame that depends on it is garbage-collected.
"""

from __future__ import annotations

import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame


CACHE_CONF = "spark.prism.cacheWorkingSets"


def working_set(df: DataFrame) -> DataFrame:
    """Persist ``df`` for several passes. Set ``spark.prism.cacheWorkingSets``
    to ``false`` where re-reading the (compressed, column-pruned) source is cheaper
    than caching the projection, e.g. very wide scans on a cluster with slow local disks."""
    if df.sparkSession.conf.get(CACHE_CONF, "true").lower() == "false":
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release_with(result: DataFrame, work: DataFrame) -> DataFrame:
    """Unpersist ``work`` once ``result`` is no longer referenced."""
    fin = weakref.finalize(result, _quiet_unpersist, work)
    fin.atexit = False  # the JVM may be gone at interpreter exit
    return result


def _quiet_unpersist(work: DataFrame) -> None:
    try:
        work.unpersist()
    except Exception:  # noqa: BLE001 -- session already stopped
        pass
