"""Session helpers: lineage cuts that survive executor loss, and size checks before anything is collected."""
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names in spark.checkpoint.dir; a local one only where unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def bounded_rows(df: DataFrame, limit: int, what: str):
    """Rows of a small parameter table; refuses to bring more than `limit` of them to the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is meant to be a small parameter table")
    return rows


def local_session(cores: str = "*", app: str = "shotweave") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
            .getOrCreate())


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables: below the cluster's checkpoint folder, a local one only where that is unset."""
    import uuid
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared work folder, worked out now and once; later reads take only the columns they need."""
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
