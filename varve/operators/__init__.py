"""Tensor operators as Spark plans: column expressions and relations of elements."""
