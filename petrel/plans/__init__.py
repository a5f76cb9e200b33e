"""Composed jobs, stand-in fixtures, the query catalog and its SQL oracle."""
