"""Readers and writers of the tables that the operators share."""
