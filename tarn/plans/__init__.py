"""Registered queries and their SQL equivalents."""
