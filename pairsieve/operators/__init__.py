"""DataFrame → DataFrame operators on preference pairs."""
