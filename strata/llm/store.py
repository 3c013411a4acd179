"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset a local master (tests) gets a temporary one; a cluster is refused, as its machines share no such folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
            at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/strata/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read from there: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/strata/" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where docs has a column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def attached(docs: DataFrame, keys: dict[str, Column], more: DataFrame, how: str = "left") -> tuple[DataFrame, dict[str, str]]:
    """docs joined with ``more`` where its columns named by ``keys`` equal these expressions of docs, null equal to null.

    No column of docs is renamed or hidden: those of ``more`` get names that docs lacks.  Returns the rows
    and the new name of each column of ``more``.  Both sides are dealt by the keys and ``more`` is hashed.
    """
    names = dict(zip(more.columns, fresh(docs, *more.columns), strict=True))
    side = more.select(*[column(c).alias(names[c]) for c in more.columns])
    same = F.lit(True)
    for name, value in keys.items():
        same = same & value.eqNullSafe(column(names[name]))
    return docs.join(side.hint("shuffle_hash"), same, how), names
