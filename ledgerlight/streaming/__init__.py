"""The same features and frozen models over streams."""
