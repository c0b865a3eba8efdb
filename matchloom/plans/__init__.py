"""Registered queries: every operator applied to the generated tables, each with the SQL it must equal."""
