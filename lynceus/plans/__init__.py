"""Plans over entities, and the registered queries."""
