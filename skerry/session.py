"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings a query may rely on. All can be set at run time on a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is cut into several tasks at run time; no operator here salts by hand.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Size check for broadcasts: no operator hints, Spark compares its estimate with this bound
    # and falls back to a shuffled join above it.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
}


def build_session(app_name: str = "skerry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`RUNTIME_CONF` applied; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    It is the one the context has already, else the one named in ``spark.checkpoint.dir``, else,
    for a local master, a folder beside the warehouse.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/../checkpoints"


def checkpointed(df):
    """``df`` cut from its lineage by a reliable checkpoint in :func:`shared_folder`."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
