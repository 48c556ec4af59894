"""Incremental reading of new scenario files."""
