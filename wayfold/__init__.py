"""wayfold: batches of routing instances as DataFrames.

Every table carries ``instance_id`` as its leading key, so one plan serves one
instance or millions of them.  Relational work is declared with the DataFrame
and SQL API; sequential search runs in Arrow kernels keyed by instance.
"""

__version__ = "0.1.0"
