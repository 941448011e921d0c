"""Byte streams as images and back."""
