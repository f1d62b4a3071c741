"""Registered queries: operators applied to the star tables, with SQL that must give the same rows."""
