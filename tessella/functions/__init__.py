"""Byte-exact column functions."""
