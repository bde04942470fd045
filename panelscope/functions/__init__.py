"""Column-expression helpers and distributed ranking primitives."""
