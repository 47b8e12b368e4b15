import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("anomalens-tests")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sales(spark):
    rows = [(11, "2026-02-05", "north", "tea", 120.0), (12, "2026-02-17", "north", "rice", 280.0),
            (13, "2026-03-02", "north", "tea", 90.0), (14, "2026-03-11", "north", "rice", 270.0),
            (15, "2026-03-19", "south", "tea", 200.0)]
    text = spark.createDataFrame(rows, "order_id int, order_date string, region string, category string, gmv double")
    return text.withColumn("order_date", text.order_date.cast("date"))
