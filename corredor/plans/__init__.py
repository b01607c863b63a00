"""Models of the transit warehouse, one function per relation."""
