"""Readers of provider payloads, driver tables, and writers."""
