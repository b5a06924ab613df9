"""End-to-end plans and the catalog of registered queries."""
