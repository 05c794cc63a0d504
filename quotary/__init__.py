"""Quotations of known passages in large document collections, and reports on how documents are read, on Spark."""
