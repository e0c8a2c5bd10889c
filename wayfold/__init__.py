"""Analytics over position traces and other personal time series, and preparation of training text, on Spark."""
