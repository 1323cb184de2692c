"""Whole queries: derived inputs, the registered queries with their SQL, and the report."""
