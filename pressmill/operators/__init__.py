"""Table-to-table operators built from DataFrame joins, aggregates and windows."""
