"""Composed queries and the workspace facade."""
