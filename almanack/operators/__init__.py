"""Operators over observation tables and catalogues."""
