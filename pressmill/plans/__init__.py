"""Composite jobs that chain the operators."""
