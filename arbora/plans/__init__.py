"""Registered queries over the test tables, and the adapter that makes DAGs of them."""
