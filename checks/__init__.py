"""Independent SQL of the registered queries, for comparison on another engine."""
