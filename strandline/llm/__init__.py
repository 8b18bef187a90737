"""Operators for preparing training text: one module an operator, `queries` registers them."""
