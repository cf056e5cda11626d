"""Operators on growing folders of files."""
