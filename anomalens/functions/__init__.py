"""Column functions. The few Arrow UDFs here travel to the executors by value, so
a cluster needs no installed copy of this package."""

from pyspark import cloudpickle

from anomalens.functions import similarity, values

cloudpickle.register_pickle_by_value(similarity)
cloudpickle.register_pickle_by_value(values)
