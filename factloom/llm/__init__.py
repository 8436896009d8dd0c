"""Operators of a training-data pipeline; nothing else in factloom imports them."""
