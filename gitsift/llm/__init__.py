"""Operators on text and item collections at corpus scale."""
