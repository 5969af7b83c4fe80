"""Relational operators over graph, snapshot, history and task tables."""
