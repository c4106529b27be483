"""Making this package importable in Python workers."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

from pyspark.sql import SparkSession

from trafficgraph.session import ensure_checkpoint_dir


def prepare(spark: SparkSession) -> None:
    """Name the shared folder and send the package to the workers, once per context.

    The archive is written through Spark's file system to the shared checkpoint
    folder and handed to ``addPyFile``, so driver and executors need no common
    local path.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    sc = spark.sparkContext
    if getattr(sc, "_trafficgraph_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.writestr(zipfile.ZipInfo(os.path.relpath(full, root)), open(full, "rb").read())
    data = held.getvalue()
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/trafficgraph_{hashlib.sha256(data).hexdigest()[:12]}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    sc._trafficgraph_shipped = True
