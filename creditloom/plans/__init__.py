"""Table build order and registered queries."""
