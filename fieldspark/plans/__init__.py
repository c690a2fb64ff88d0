"""Multi-operator compositions."""
