"""The package on the executors of a cluster that does not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Zips this package and hands it to Spark, which puts it on the path of all Python tasks of the session.

    Call it once, before the first job. Returns the zip, which Spark serves from the
    driver; on executors nothing is written but by Spark itself.
    """
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpuslens-")) / "corpuslens.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    return str(target)
