"""Plan-level helpers, fixture views and the query registry."""
