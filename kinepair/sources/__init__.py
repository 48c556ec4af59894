"""Readers, writers, staging and asset verification."""
