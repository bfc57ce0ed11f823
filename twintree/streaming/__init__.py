"""Analyses over entries that keep arriving."""
