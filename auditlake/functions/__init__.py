"""Column builders that Catalyst can optimise."""
