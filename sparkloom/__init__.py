"""Analytics over ordered, record-structured data, written for Spark's DataFrame and SQL engine."""
