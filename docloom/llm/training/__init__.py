"""Offline training of the models this subpackage ships."""
