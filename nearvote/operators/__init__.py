"""Search, index building, evaluation and learning."""
