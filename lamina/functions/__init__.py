"""Functions of the dialect by name."""
