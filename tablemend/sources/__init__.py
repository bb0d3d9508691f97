"""Reading tables, finding datasets, writing tables and metrics."""
