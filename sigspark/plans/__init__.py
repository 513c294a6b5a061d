"""Registered queries: operators applied to the test tables, each with the SQL that says the same."""
