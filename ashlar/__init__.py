"""Ashlar: code-intelligence analytics as DataFrame plans."""
