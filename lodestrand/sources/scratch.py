"""Tables that cut a plan in two."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder in ``spark.checkpoint.dir`` and read back: what is read often is computed once, and later plans stay short.

    A local session that names no folder gets a temporary one; on a cluster, whose machines share none, that raises.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
        if not path:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
            spark.sparkContext.setCheckpointDir(path)
    path = f"{path.rstrip('/')}/lodestrand-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
