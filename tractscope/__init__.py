"""tractscope: incident analytics on Spark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark's own expressions, joins, windows and MLlib, usable with
``df.transform``.
"""

__version__ = "0.1.0"
