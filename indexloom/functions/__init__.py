"""The scalar expression language as column expressions."""
