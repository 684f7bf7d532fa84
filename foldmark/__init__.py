"""foldmark: leak-safe tabular features and evaluation as Spark DataFrames.

Every statistic that is applied to a row is learned from rows outside that
row's fold.  The package expresses this as fold-aware aggregation: one scan
yields the statistics for "all rows but fold k" for every k at once.
"""

__version__ = "0.1.0"
