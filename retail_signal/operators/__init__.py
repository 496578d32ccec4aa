"""DataFrame operators: aggregation, calendar, temporal windows, store
features, cleaning, profiling, evaluation and domain measures."""
