"""Training-data operators: one module per operator, plus the registry of their queries."""
