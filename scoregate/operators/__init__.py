"""Operators of the scoregate library."""
