"""Registered queries over the test tables, each with the SQL it has to agree with."""
