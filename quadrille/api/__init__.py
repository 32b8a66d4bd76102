"""Tools, result formatting, discovery and the command line."""
