"""Reusable DataFrame operators. All are lazy and hold no state."""
