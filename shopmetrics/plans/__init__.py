"""Plan inspection helpers and the catalogue of registered queries."""
