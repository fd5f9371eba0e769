"""Rule engines, composite reports and the registered queries."""
