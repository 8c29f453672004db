"""Column and DataFrame building blocks for text and distances."""
