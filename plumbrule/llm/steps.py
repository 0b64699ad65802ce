"""Steps of long jobs: results that are written, and whose shuffle files need not stay."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbrule.core.session import cut_lineage

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back; Spark drops the step's shuffle files when it ends.

    While the step runs its files stay, so a lost executor costs no more than usual; afterwards the written
    table replaces them.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(_CLEAN, before)
