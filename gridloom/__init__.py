"""Analytics for gridded, point-wise and time-series forecast data on Spark."""
