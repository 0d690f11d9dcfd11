"""Versioned-table engine and set-based operator library on PySpark."""
