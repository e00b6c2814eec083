"""Reading tables, saved layouts and caches."""
