"""Column builders: pure expressions without shuffles or Python workers."""
