"""Formulaic factor analytics and corpus operators on Spark."""
