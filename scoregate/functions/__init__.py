"""Functions of the scoregate library."""
