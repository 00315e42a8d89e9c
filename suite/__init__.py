"""Registered queries and their equivalent SQL."""
