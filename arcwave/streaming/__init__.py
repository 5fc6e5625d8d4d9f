"""Graphs over streams of edges."""
