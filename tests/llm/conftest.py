"""Nothing of its own: the session comes from the tests' root."""
