"""Plans of the scoregate library."""
