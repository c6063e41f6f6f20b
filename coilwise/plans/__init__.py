"""Composed jobs, from tables to decisions."""
