"""retail_signal: Spark-native store-day sales features and decline signals.

Invoice lines are rolled up to one row per (store, date); calendar, holiday,
price, lag, rolling, momentum, decline and store features are derived with
DataFrame / SQL operators.  Profiling, association statistics, gap filling,
supervised-window preparation, forecast baselines and metrics, rule
compliance, drift measures and incremental streaming updates sit around it.
"""

__version__ = "0.1.0"
