"""Operators for training-text preparation. Nothing outside this subpackage imports it."""
