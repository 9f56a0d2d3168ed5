"""Registered queries and the star schema that they stand on."""
