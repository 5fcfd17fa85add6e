"""Training-data pipeline operators: one module per operator, ``catalog`` registers their queries."""
