"""Spark jobs for a versioned, cited knowledge base of source code and text."""
