"""Helpers that the operators for training data share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension → language of a code file.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df over at least twice as many partitions as there are task slots, for work that costs far more than moving its rows.

    Tables of many files keep their partitions: nothing is shuffled where the scan is parallel already.
    """
    least = least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def map_columns(df: DataFrame, columns: list[str], rule: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that rule yields for each row of the named columns (given as positional values), by Arrow batches.

    Only the named columns are read, so further columns of df, whatever their names, cost nothing and clash with nothing.
    """
    names = [x.strip().split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(",")]
    arrow = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(arrow)
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = [out for row in zip(*lists) for out in rule(*row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), wanted)], names=names)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by checkpoint() in the shared folder that the session names; on one machine also in one of its own.

    A cluster without a shared folder is an error: what executors write on their own disks nobody else can read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """df persisted and filled, so that branches that run at the same time read it and none computes it again."""
    df = df.persist()
    df.count()
    return df
