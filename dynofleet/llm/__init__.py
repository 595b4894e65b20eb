"""Training-data operators: tokenising, filtering, near duplicates, search and packing on Spark.

Nothing else in the library imports this subpackage.
"""
