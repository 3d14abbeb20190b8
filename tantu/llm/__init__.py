"""Operators for preparing text and vectors on a large scale. Nothing outside this package imports it."""
