"""Operators over observation, occurrence and registry tables."""
