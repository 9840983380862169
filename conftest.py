"""Makes the repository's top importable from tests."""
