"""Sources of the scoregate library."""
