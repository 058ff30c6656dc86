"""A folder of samples: one CSV folder for each group and a schema file; splits take whole groups.

Writing replaces the groups it brings and leaves the others.  The schema file is
written by the first write and checked by every later one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_FILE = "schema.json"


def _schema_path(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, SCHEMA_FILE)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_schema(spark: SparkSession, folder: str) -> dict | None:
    path, fs = _schema_path(spark, folder)
    if not fs.exists(path):
        return None
    text = "".join(r.value for r in spark.read.text(path.toString(), wholetext=True).collect())
    return json.loads(text)


def write_groups(df: DataFrame, folder: str, group: str, features: list[str], target: str) -> None:
    """Write features and target, one partition for each group; only the groups in ``df`` are replaced."""
    spark = df.sparkSession
    wanted = {"group": group, "features": features, "target": target, "types": {c: df.schema[c].dataType.simpleString() for c in (*features, target)}}
    known = _read_schema(spark, folder)
    if known is None:
        path, fs = _schema_path(spark, folder)
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(wanted).encode()))
        stream.close()
    elif known != wanted:
        raise ValueError("the folder holds samples of another schema")
    rows = df.select(*features, target, F.col(group).cast("string").alias(group))
    if not rows.where(F.col(group).isNull()).isEmpty():
        raise ValueError("every sample needs a group")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy(group).csv(folder)


def read_groups(spark: SparkSession, folder: str) -> DataFrame:
    """All samples with their group, in the types of the schema file; no inference."""
    known = _read_schema(spark, folder)
    if known is None:
        raise FileNotFoundError(f"{folder}/{SCHEMA_FILE}")
    columns = [T.StructField(c, T.DataType.fromDDL(known["types"][c])) for c in (*known["features"], known["target"])]
    schema = T.StructType([*columns, T.StructField(known["group"], T.StringType())])
    return spark.read.schema(schema).option("header", "true").option("pathGlobFilter", "*.csv").csv(folder)


def split_groups(df: DataFrame, group: str, held_out: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) with whole groups in one of them, chosen by a seeded hash; a null group counts as one group."""
    if not 0 <= held_out <= 1:
        raise ValueError("the share must lie between 0 and 1")
    place = F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(seed)), F.lit(1_000_000)) < int(held_out * 1_000_000)
    return df.where(~place), df.where(place)
