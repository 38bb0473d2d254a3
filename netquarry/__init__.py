"""netquarry: network threat-hunting analytics expressed as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame, built from
Spark's own expressions, so Catalyst plans it and the same function runs on a
batch table, on one window of a table, or inside ``foreachBatch`` of a stream.
"""

__version__ = "0.1.0"
