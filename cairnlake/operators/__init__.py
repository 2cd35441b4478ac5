"""DataFrame operators; each takes column roles, not fixed tables."""
