"""Stateful and windowed streams with their batch twins."""
