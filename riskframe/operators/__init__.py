"""The operators, one module per capability."""
