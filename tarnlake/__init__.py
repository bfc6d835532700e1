"""A relational engine on Spark: typed tables, key lookups, predicates, sorts, merge joins, a replayable log."""
