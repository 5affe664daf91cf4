"""Readers of artifacts, rule files and lists."""
