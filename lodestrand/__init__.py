"""lodestrand: stream segmentation and signal analytics on Spark DataFrames."""

from pathlib import Path

from pyspark import SparkContext

ROOT = str(Path(__file__).resolve().parent.parent)


def on_workers() -> None:
    """Let Python workers import this package from where the driver did. On a cluster it must be there too: installed, or sent as a py-file."""
    environment = SparkContext._active_spark_context.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])
