"""Records to scan, from tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATIONS = "conv_id long, turn long, role string, text string"
CALLS = "agent_id string, ts timestamp, seq long, tool_name string, arguments map<string,string>, mcp_server string"
ENVELOPES = "agent_id string, ts timestamp, seq long, headers map<string,string>, body string"


def turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns with the direction they are scanned in: what the assistant says is output, all else input."""
    return spark.read.schema(CONVERSATIONS).parquet(path).withColumn("direction", F.when(F.col("role") == "assistant", "output").otherwise("input"))


def stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def tool_calls(df: DataFrame, body: str = "value") -> DataFrame:
    """Calls from JSON lines; nested arguments stay JSON text."""
    raw = F.from_json(body, "agent_id string, ts timestamp, seq long, tool_name string, arguments map<string,string>, mcp_server string")
    return df.select(raw.alias("r")).select("r.*")
