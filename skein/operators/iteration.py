"""Tables between rounds of iterative operators, kept in the folder that driver and executors share; ranks over whole tables, connected ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of this name under spark.checkpoint.dir; where that is unset, as in tests, under a local folder, on local masters only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="skein-")
        _OWN[spark.sparkContext.applicationId] = where
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a settled table beyond which joins shuffle it. Spark judges a table by the bytes of its files, which may be a fortieth of what it takes as a broadcast.
BROADCAST_ROWS = 1 << 16


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder. It goes out as a broadcast only with few rows, or by `small`."""
    path, seen = shared_path(df.sparkSession, "round"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out, rows = df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
    out = out.hint("merge") if rows > BROADCAST_ROWS else out
    out._skein_path, out._skein_rows = path, rows
    return out


def dealt(df: DataFrame, keys: list[str], made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What `made` makes of df, dealt by keys that it keeps, as a bucketed table in the shared folder: joins on the keys shuffle the other side only. Its entry in the catalog goes when it is discarded."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "dealt")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"skein_{uuid.uuid4().hex}"
    made(df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._skein_path, out._skein_name = path, name
    return out


def union_of(tables: list[DataFrame]) -> DataFrame:
    """All rows of settled tables, shuffled in joins if they are many together."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.hint("merge") if sum(getattr(t, "_skein_rows", 0) for t in tables) > BROADCAST_ROWS else out


def counted(df: DataFrame, **numbers: Column) -> tuple[DataFrame, dict]:
    """df settled, and aggregates over its rows, which come with the job that writes it."""
    seen = Observation()
    return settle(df.observe(seen, *[c.alias(n) for n, c in numbers.items()])), seen.get


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        if name := getattr(df, "_skein_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_skein_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows of a table up to which one task takes all of it: rounds on so few need no shuffle.
FEW = 1 << 18


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df, a settled table of so many rows (or of so many at most, once what follows in the same job is done), as one partition if they are few."""
    return df.coalesce(1) if rows <= FEW else df


def in_steps(first: DataFrame, step: str, times: int, **tables: DataFrame) -> DataFrame:
    """`times` steps as one query: step is SQL over {rows}, with {i} for the number of the step, and over the named tables. One statement is analysed once, whatever its length."""
    names = {n: "{" + n + "}" for n in tables}
    parts = [f"r{i + 1} AS ({step.format(rows=f'r{i}', i=i, **names)})" for i in range(times)]
    return first.sparkSession.sql(f"WITH r0 AS (SELECT * FROM {{first}}), {', '.join(parts)} SELECT * FROM r{times}", first=first, **tables)


#: Bytes up to which a settled table goes out as a broadcast.
SMALL = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df, a settled table, with a broadcast hint if the bytes of its values, counted now, are few."""
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) + 8 if t == "string" else F.lit(16) for c, t in df.dtypes]
    held = df.agg(F.coalesce(F.sum(sum(widths, F.lit(8))), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= SMALL else df


def ahead(step: DataFrame) -> DataFrame:
    """(id, to): each step followed by the step of its target."""
    up = step.select(F.col("id").alias("to"), F.col("to").alias("up"))
    return step.join(small(up), "to", "left").select("id", F.coalesce("up", "to").alias("to"))


def roots(pairs: DataFrame) -> DataFrame:
    """(id, root) of pairs (a long, b long): connected ids get the same root, one of them; an id that is not listed is its own. In each round every id moves
    to its least neighbour, if that is less, and on to where that one moves; pairs are renamed, and those within one id go. As ids are hashes, in no
    order along the graph, rounds grow with its logarithm."""
    pairs = settle(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    steps: list[DataFrame] = []
    while not pairs.isEmpty():
        steps.append(settle(ahead(settle(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))))))
        to = small(steps[-1])
        moved = pairs.join(to.withColumnRenamed("id", "a"), "a").select(F.col("to").alias("x"), "b")
        moved = moved.join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        pairs = settle(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    out = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for step in reversed(steps):
        later = small(out)
        own = step.join(later.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
        out = settle(own.union(out.join(step, "id", "left_anti")))
    return out


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with the place of each row in this order, from 1: range partitions are sorted and numbered side by side, and their sizes, one row each, summed."""
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(sort.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.col("_before") + (F.col("_id") - F.shiftleft("_part", 33)) + 1
    return rows.join(F.broadcast(before), "_part").withColumn(name, place).drop("_id", "_part", "_before")
