"""Operators of a training-data pipeline over tables of documents, vectors and
pages. Functions that run in Python tasks travel by value, so executors need no
copy of the package. Nothing outside this folder imports it."""

from pyspark import cloudpickle

from anomalens.llm import (buffers, common, conversation_repair, mixing, neighbours, ngram_join, packing, quality, sharding,
                           suffix_dedup, toxicity, training, warc, whitening)

for _module in (buffers, common, conversation_repair, mixing, neighbours, ngram_join, packing, quality, sharding, suffix_dedup,
                toxicity, training, warc, whitening):
    cloudpickle.register_pickle_by_value(_module)
