"""The request loop."""
