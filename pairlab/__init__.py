"""pairlab: text-pair analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; heavy work is expressed
with built-in Spark SQL expressions so Catalyst can prune, push down and codegen.
"""

__version__ = "0.1.0"
