"""DataFrame operators: joins, sequence work, aggregates and edits."""
