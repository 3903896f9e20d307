"""Live counts and rule checks over streams."""
