"""DataFrame -> DataFrame building blocks (joins, aggregations, ranking)."""
