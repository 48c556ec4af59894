"""Composed plans: fixture views, workflows and the query catalogue."""
