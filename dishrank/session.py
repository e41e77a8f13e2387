"""Session settings, the shared work folder and its files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def get_session(app: str = "dishrank", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE on and UTC time; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only by a local session that names none.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app_id] = tempfile.mkdtemp(prefix="dishrank-")
    return _LOCAL_ROOTS[app_id]


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder, never handed out twice."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """Spark's own file system client, so any storage Spark reads will do."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def is_file(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path) and files.getFileStatus(hadoop_path).isFile()


def delete_path(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file."""
    files, hadoop_path = _file_system(spark, path)
    files.create(hadoop_path, True).close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(hadoop_path))
