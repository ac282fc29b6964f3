"""Registered queries: derived inputs, plans and the SQL they are checked against."""
