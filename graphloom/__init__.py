"""Analytics over collections of loosely structured, cross-referenced objects, on Spark."""
