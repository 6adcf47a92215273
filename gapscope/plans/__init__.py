"""Runnable queries over the star-schema tables, each with its SQL statement."""
