"""End-to-end flows and the query registry."""
