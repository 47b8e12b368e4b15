"""Spark-native business anomaly diagnosis and query-session auditing.

Every public function takes and returns DataFrames or Columns; the plan stays
declarative so that Catalyst, AQE and Tungsten choose the physical strategy.
"""
