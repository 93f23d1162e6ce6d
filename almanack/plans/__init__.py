"""Requests, recipes, and the registered queries."""
