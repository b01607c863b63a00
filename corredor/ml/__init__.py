"""Feature-to-decision operators on MLlib."""
