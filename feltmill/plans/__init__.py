"""Composed jobs and the catalog of registered queries."""
