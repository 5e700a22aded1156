"""Training-data operators: one module per operator, `registry` for the queries."""
