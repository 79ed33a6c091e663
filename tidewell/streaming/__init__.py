"""Stateful stream operators and their batch forms."""
