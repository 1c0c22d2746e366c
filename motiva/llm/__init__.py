"""Operators for building training data: one module per operator, plus ``queries`` for the registered ones."""
