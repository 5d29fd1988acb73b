"""Training-data operators: one module each, queries in ``stoa.llm.queries``."""
