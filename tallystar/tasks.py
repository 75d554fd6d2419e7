"""Code that runs inside Python tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    """Send a module's functions with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
