"""Joins, chunking, facts, search, fusion and access rules as DataFrame jobs."""
