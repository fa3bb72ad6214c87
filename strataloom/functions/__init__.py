"""Column builders: every scalar rule of the engine as a built-in expression (no Python in the hot path)."""
