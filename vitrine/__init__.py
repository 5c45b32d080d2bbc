"""vitrine: catalog analytics and content-based recommendation as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame. Nothing here collects data to the driver except explicit, size
checked parameter tables (query vectors, seed lists).
"""

__version__ = "0.1.0"
