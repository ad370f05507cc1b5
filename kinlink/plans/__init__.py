"""Plans of the record-linkage engine."""
