"""Venue resolution, evidence mining, ranking and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from taproom.session import build_session  # noqa: E402

__all__ = ["build_session"]
