"""Analytics over signed provenance records of AI outputs, on Spark."""
