"""Registered queries: each operator bound to the driver's tables, with its oracle SQL."""
