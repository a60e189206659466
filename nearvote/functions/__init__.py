"""Column expressions: features, quantization, distances."""
