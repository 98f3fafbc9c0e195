"""Analytics over versioned, content-addressed backup data, expressed in Spark."""
