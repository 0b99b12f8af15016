"""DataFrame operators by family."""
