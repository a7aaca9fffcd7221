"""See the README for the list of operators."""
