"""Places and tables that every executor can reach.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; when a local session has none (tests on one machine), a
folder of its own is set once. A session on a cluster without that setting is refused: nothing here writes to a
machine-local folder there.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows (a few numbers each) may be broadcast; 16 bytes a row make 16 MB.
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get("root")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own["root"] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return root.rstrip("/")


_own: dict[str, str] = {}


class Workspace:
    """A folder for the intermediate tables and files of one query; deleted when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        store, path = self._place(self.uri)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _place(self, uri: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the table that reads it back."""
        path = f"{self.uri}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            store, path = self._place(f"{self.uri}/{name}")
            store.delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows are few; otherwise leave a shuffled join to the planner."""
    return F.broadcast(df) if rows <= most else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: White space that separates words, in every operator: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a pattern of one word, for Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column):
    """Number of words of a non-null text column."""
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def let(value, body):
    """body(value) with value computed once, although a lambda inside body uses it at every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
