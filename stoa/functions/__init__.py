"""See the package docstring of ``stoa``."""
