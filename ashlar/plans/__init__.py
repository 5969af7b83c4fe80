"""Textual languages compiled to DataFrame plans."""
