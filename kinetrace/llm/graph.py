"""Connected components, as the library has them."""

from kinetrace.operators.graph import components

__all__ = ["components"]
