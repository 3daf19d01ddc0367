"""A session for local use; on a cluster the deployment's own session serves."""

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Local session in UTC with adaptive execution."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tidemill")
    for k, v in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items() | conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
