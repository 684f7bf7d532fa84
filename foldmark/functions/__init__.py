"""Column builders: no job is run by anything in this package."""
