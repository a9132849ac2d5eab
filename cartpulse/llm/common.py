"""Helpers shared by the operators: shared storage, checked broadcasts, numbering, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of a narrow side (ids, hashes, short words: tens of bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
# Spark then deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own; a session
    on a cluster raises, as a machine-local folder would lose data there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cartpulse-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers (``addPyFile``, once per application); returns ``spark``.

    The operators' Python functions import it; executors need not have it installed.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="cartpulse-ship-")) / "cartpulse_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent).as_posix())
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: later stages read the files, so a lost executor costs
    no recomputation and values such as row positions never change.  The
    shuffle files that writing took are deleted: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def released(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` (or ``positioned``) gave and that no later plan reads."""
    for table in tables:
        session = table.sparkSession
        folder = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_path)
        folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Does ``df`` have at most ``rows`` rows?  A full distributed count of narrow rows."""
    return df.count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven small, else as it is (a shuffled join).

    ``df`` should be cheap to read (written, or a small table): it is counted first.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def positioned(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows) written with each row's position in ``_pos``: unique, and fixed from now on."""
    return written(df.withColumn("_pos", F.monotonically_increasing_id()), "positioned")


def numbered(rows: DataFrame, keys: list[str], name: str, block_bits: int = 16) -> DataFrame:
    """``rows`` (as ``positioned`` gives them) plus ``name``: numbers from 0, without gaps, within ``keys``.

    No window ever holds a whole key: positions are cut into blocks of
    ``2**block_bits`` rows, rows are numbered inside (keys, block), and a
    block's start is the sum of the counts of the blocks before it (one row per
    key and block).  A key with a third of all rows is thus spread over as many
    tasks as it has blocks.  The keys must not be null.
    """
    rows = rows.withColumn("_block", F.shiftright("_pos", block_bits))
    starts = (
        rows.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("_n")
    )
    inner = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_pos"))
    return (
        rows.withColumn("_row", inner)
        .join(starts, [*keys, "_block"])
        .withColumn(name, (F.col("_row") - 1 + F.coalesce("_start", F.lit(0))).cast("long"))
        .drop("_pos", "_block", "_row", "_start")
    )


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node, root the smallest node.

    Rounds of two steps on edges (v, r) with v > r: every v keeps its
    smallest r and its other ends are linked to that one; then r is replaced
    by r's own end (a join, so a hub with a third of all edges is split by
    AQE, and no group of a hub is ever gathered).  v has as many rows as it
    has direct smaller neighbours.  Each round ends in a reliable
    checkpoint in the shared folder.  Raises if ``max_rounds`` don't settle.
    """
    shared_folder(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).filter("v > r")
    state = pairs.distinct().checkpoint()
    for _ in range(max_rounds):
        least = state.groupBy("v").agg(F.min("r").alias("m"), F.count(F.lit(1)).alias("n")).checkpoint()
        many = least.filter("n > 1").select("v", "m")
        extra = (
            state.join(many, "v").filter("r > m").select(F.col("r").alias("v"), F.col("m").alias("r"))
        )
        parents = least.select(F.col("v").alias("r"), F.col("m").alias("up"))
        jumped = (
            least.select("v", F.col("m").alias("r"))
            .join(parents, "r", "left")
            .select("v", F.coalesce("up", "r").alias("r"), F.col("up").isNotNull().alias("moved"))
        )
        after = (
            jumped.unionByName(extra.select("v", "r", F.lit(True).alias("moved")))
            .groupBy("v", "r")
            .agg(F.max("moved").alias("moved"))
            .checkpoint()
        )
        state = after.select("v", "r")
        if not after.filter("moved").limit(1).count():
            roots = state.select("r").distinct().select(F.col("r").alias("node"), F.col("r").alias("root"))
            return state.select(F.col("v").alias("node"), F.col("r").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
