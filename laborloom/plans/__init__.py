"""End-to-end reports composed from the operators."""
