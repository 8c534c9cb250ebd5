"""Writers for the two tables, their exports and the query cache."""
