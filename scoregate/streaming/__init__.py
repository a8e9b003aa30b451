"""Streaming of the scoregate library."""
