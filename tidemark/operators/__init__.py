"""Reusable DataFrame operators that the marts are composed from."""
