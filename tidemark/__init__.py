"""Event-window analytics over append-only, time-stamped message logs, on Spark."""

from pathlib import Path

__version__ = "0.1.0"


def on_workers(spark) -> None:
    """Lets Python workers that share the driver's folders import this package, wherever the session was started.

    On a cluster the package is shipped as usual (--py-files); this changes nothing there.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])
