"""Session settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "karst", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (dots written as __)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names; only a local session may do without, and gets one of this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="karst-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the checkpoint folder, which all executors share."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
