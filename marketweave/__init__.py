"""marketweave: Spark-native retail / market analytics.

Sales facts are conformed, joined to calendar, stock, commodity and
macro-economic series at day / month / year grain, aggregated, turned into
time-series features, and fed to a regression and a seasonal forecast. Every
operator is a ``DataFrame -> DataFrame`` function over the Spark DataFrame
API, so Catalyst and adaptive execution plan the work.
"""

__all__ = ["session"]
