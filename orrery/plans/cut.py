"""Cutting lineage: results that several later steps read are written once to a shared folder.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only on a single machine and where that setting is absent
(unit tests, a notebook) a folder below the system's temporary directory is used instead. What is written is removed when the
application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

_own: dict[str, str] = {}
_marked: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder, which all executors can reach."""
    app = spark.sparkContext.applicationId
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return f"{named.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def _removed_at_end(spark: SparkSession, folder: str) -> None:
    if folder not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _marked.add(folder)


def _number_lists(schema: StructType) -> list[str]:
    """Parquet paths of the floating-point numbers in lists: hardly one comes twice, so a dictionary is work for nothing."""
    paths = []
    for f in schema.fields:
        if isinstance(f.dataType, ArrayType):
            item, at = f.dataType.elementType, f"{f.name}.list.element"
            inside = [(f"{at}.{x.name}", x.dataType) for x in item.fields] if isinstance(item, StructType) else [(at, item)]
            paths += [p for p, t in inside if isinstance(t, (FloatType, DoubleType))]
    return paths


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it back.

    The rows survive the loss of any executor, the plan above starts from a plain scan, and the optimizer
    sees true sizes (so it broadcasts a side only when the written files prove that it is small).
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in _number_lists(df.schema)}
    df.write.mode("error").option("compression", "zstd").options(**plain).parquet(path)
    _removed_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(path)
