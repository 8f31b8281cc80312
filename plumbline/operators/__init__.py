"""Reusable DataFrame operators: governed metrics, timelines, profiles, checks."""
