"""Workflows that compose operators."""
