"""Queries over the catalogue tables, each with the SQL that gives the same rows."""
