"""Column builders: ids, descriptors, scopes, text."""
