"""Patterns: syntax, rewriting and matching automata."""
