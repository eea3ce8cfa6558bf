"""Spark jobs over large document collections."""
