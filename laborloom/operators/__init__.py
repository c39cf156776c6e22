"""DataFrame operators, one module per metric family."""
