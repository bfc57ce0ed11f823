"""Whole analyses put together from operators, and their reports."""
