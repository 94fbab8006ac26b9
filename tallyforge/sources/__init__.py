"""Readers for provider files, and the testbed adapter."""
