"""Folders for files that an application writes and reads again itself."""

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which must be one that the driver and all executors mount. Only a local master may have none
    (tests): it gets one of its own. It goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        path = re.sub(r"^file:(//)?(?=/)", "", found)
        if "://" in path:
            raise ValueError(f"{found} is no folder that executors mount; POD5 and BAM files need one")
        path = os.path.join(path, f"porelake-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}")
        os.makedirs(path)
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix=f"porelake-{name}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    atexit.register(shutil.rmtree, path, True)
    return path
