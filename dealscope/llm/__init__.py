"""Operators for preparing language-model training text; nothing outside this folder imports it."""
