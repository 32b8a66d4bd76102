"""Function registry, aggregations, and the derived library."""
