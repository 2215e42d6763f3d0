"""Analytics over ordered events and market-style time series on Spark."""
