"""A grid of settings worked off in waves, each kept whole or not at all, so that a stopped job goes on where it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import grouped_ridge
from .scan import ScanConfig, states


def around(centre: dict, axes: dict[str, list]) -> list[dict]:
    """The centre with one setting changed at a time, each combination once, in order."""
    out = []
    for axis, values in axes.items():
        out += [c for v in values if (c := {**centre, axis: v}) not in out]
    return out


def crossed(axes: dict[str, list]) -> list[dict]:
    """All combinations of the axes' values."""
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all waves in the folder that were written whole; None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/wave-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    waves = [str(f.getPath().getParent().toString()) for f in found or []]
    return spark.read.parquet(*waves) if waves else None


def run_grid(spark: SparkSession, cells: list[dict], work: Callable[[dict], DataFrame], folder: str, wave: int = 16) -> DataFrame:
    """The rows that `work` gives for every cell, with the cell's settings as columns before them.

    A wave of cells is one Spark job with one commit into a folder of its own; a wave without its mark of success (the driver was lost while it
    ran) is not read, and its cells are worked off again. Cells whose settings stand in a whole wave are skipped. Settings are numbers,
    strings or booleans, the same names in every cell; cells given twice are one. A cell without rows is worked off anew by each call.
    """
    cells = [c for i, c in enumerate(cells) if c not in cells[:i]]
    if not cells:
        raise ValueError("a grid needs a cell")
    names, before = list(cells[0]), finished(spark, folder)
    done = {tuple(r) for r in before.select(*names).distinct().collect()} if before is not None else set()  # settings, as many as cells
    pending = [c for c in cells if tuple(c.values()) not in done]
    for at in range(0, len(pending), wave):
        made = [work(c).select(*(F.lit(v).alias(k) for k, v in c.items()), "*") for c in pending[at : at + wave]]
        reduce(DataFrame.unionByName, made).write.parquet(f"{folder.rstrip('/')}/wave-{uuid.uuid4().hex}")
    return finished(spark, folder)


def predictability(series: DataFrame, difference: bool, dimension: int, ridge: float) -> DataFrame:
    """One row (channels, median_r2, saturated): how far channels (channel, t, value) foretell themselves by delays; saturated is the share over 0.9."""
    rows = states(series, ScanConfig(dimension=dimension, difference=difference))
    wide = rows.select("channel", "train", "target", *(F.col("own")[i].alias(f"own{i}") for i in range(dimension)))
    r2 = grouped_ridge(wide, "channel", [f"own{i}" for i in range(dimension)], ["target"], "train", ridge).where(~F.isnan("r2"))
    return r2.agg(F.count("*").alias("channels"), F.percentile("r2", F.lit(0.5)).alias("median_r2"), F.avg((F.col("r2") > 0.9).cast("double")).alias("saturated"))
