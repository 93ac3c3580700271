"""Session helpers: a local session for tests/bench and checkpoint-dir handling.

Iterative jobs (bisection steps, outer classifier iterations) cut their lineage
with *reliable* checkpoints.  On a cluster the folder must be shared storage and
is taken from the session conf ``spark.checkpoint.dir``; only a local master
without that setting gets a scratch folder of its own.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "graphssl") -> SparkSession:
    """A local session configured like the tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the SparkContext has a reliable checkpoint directory.

    Order: an already-set directory; ``spark.checkpoint.dir`` from the session
    conf; for a *local* master only, a fresh scratch folder under the temp dir.
    A cluster without ``spark.checkpoint.dir`` is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="graphssl-ckpt-",
                                   dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(scratch)
    else:
        raise RuntimeError(
            "graphssl needs a shared checkpoint folder: set spark.checkpoint.dir")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint (survives executor loss, truncates lineage).

    The checkpointed frame keeps the plan's output partitioning, so a table
    hash-partitioned on its join key stays co-partitioned across steps."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder and
    reading it back.

    Unlike an RDD checkpoint, the result is columnar: later scans read only the
    columns they use (the thin ``grp/label/finished`` part of a state table
    instead of its feature vectors) and push filters such as ``finished =
    false`` into the scan.  The files live in the shared checkpoint folder, so
    they survive the loss of an executor.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)     # no job that looks for the schema


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as a table bucketed (and sorted) on ``key``
    under the checkpoint folder.

    Two tables bucketed on their join keys with the same bucket count join
    without an exchange: an iterative job that joins a big static table (the
    graph's edges) with a per-step table (the vertices) shuffles neither of
    them for that join.  The table is registered in the session catalog only;
    its files live in the shared checkpoint folder.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    table = f"graphssl_{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(buckets, key).sortBy(key)
     .option("path", f"{base}/tables/{table}").saveAsTable(table))
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`write_table` or :func:`write_bucketed` has written
    and that no live frame reads any more (a superseded step)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/tables/"
    files = [f for f in df.inputFiles() if "/tables/" in f]
    folders = {f[:f.index("/tables/") + len("/tables/")] + f.split("/tables/", 1)[1].split("/")[0] for f in files}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own = base.split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if own not in folder:
            continue
        name = folder.rsplit("/", 1)[1]
        if name.startswith("graphssl_") and spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table_reference(df: DataFrame) -> dict | None:
    """Folder and schema of a table of :func:`write_table`, for a manifest; None for a table without files."""
    files = df.inputFiles()
    return {"path": files[0].rsplit("/", 1)[0], "schema": df.schema.jsonValue()} if files else None


def read_reference(spark: SparkSession, reference: dict | None) -> DataFrame | None:
    """The table that :func:`table_reference` described, also in another application."""
    if reference is None:
        return None
    return spark.read.schema(StructType.fromJson(reference["schema"])).parquet(reference["path"])


def _run_folder(spark: SparkSession, run: str):
    """File system and folder of a named run.  Spark gives every application a folder of its own below the
    configured one; a run lies beside them, so that another application finds it."""
    if not run or "/" in run or run.startswith("."):
        raise ValueError(f"not a name of a run: {run!r}")
    base = ensure_checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/runs/{run}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def save_manifest(spark: SparkSession, run: str, step: int, content: dict) -> None:
    """Write the manifest of a step.  It appears whole or not at all: the file is written under another name and
    then renamed.  A step that has a manifest is an error (two drivers on one run)."""
    fs, folder = _run_folder(spark, run)
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final, draft = new_path(folder, f"step-{step:08d}.json"), new_path(folder, f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps(content).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"step {step} of run {run!r} has been written by another driver")


def load_manifest(spark: SparkSession, run: str) -> tuple[int, dict] | None:
    """The last step of a run and its manifest, or None."""
    fs, folder = _run_folder(spark, run)
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    steps = sorted(n for n in names if n.startswith("step-") and n.endswith(".json"))
    if not steps:
        return None
    text = spark.read.text(f"{folder.toString()}/{steps[-1]}", wholetext=True).first()[0]
    return int(steps[-1][len("step-"):-len(".json")]), json.loads(text)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``graphssl`` importable in the Python workers (``addPyFile``).

    The pandas kernels (block distances, per-group bisection, LSH codes) are
    module functions that workers unpickle by reference, so the package must be
    on every executor's path.  When it is not installed there, this zips the
    package once per application and ships it with the job.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="graphssl-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "graphssl"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="graphssl")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


#: Rows per bucket aimed at when a bucket count is derived from the data.
BUCKET_ROWS = 1_000_000


def bucket_count(spark: SparkSession, n_rows: int) -> int:
    """Buckets for a table of ``n_rows``: about one per ``BUCKET_ROWS`` rows,
    at least 1, at most ``spark.sql.shuffle.partitions``."""
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(cap, -(-int(n_rows) // BUCKET_ROWS)))
