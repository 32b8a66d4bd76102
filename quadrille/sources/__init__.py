"""Sources, their configuration, conformance, and the panel loader."""
