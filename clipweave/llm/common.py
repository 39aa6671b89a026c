"""What several operators share: text rules, shared storage, hash remainders."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maximal runs of anything but the space and the control characters 9 to 13.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def remainder_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, **more: str) -> T.StructType:
    """The schema with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, KINDS[v]) for k, v in more.items())])


class Scratch:
    """Tables in the folder that all executors share.

    A written table cuts the lineage: an executor that is lost later costs no
    recomputation. The folder is the one in spark.checkpoint.dir; only where that
    is unset and Spark runs in one process (tests) a temporary one is made and set.
    A folder of one machine would lose tables on a cluster, so there it is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="clipweave-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
