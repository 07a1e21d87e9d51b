"""DataFrame operators: scanning, nesting, resolution, graph queries, search and export."""
