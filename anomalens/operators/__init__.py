"""Operators: DataFrames in, DataFrames out. What runs in Python tasks travels by
value, so executors need no copy of the package."""

from pyspark import cloudpickle

from anomalens.operators import retrieval

cloudpickle.register_pickle_by_value(retrieval)
