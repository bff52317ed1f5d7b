"""Readers that produce the ``files`` table."""
