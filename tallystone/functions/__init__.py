"""Column builders: numbers and text."""
