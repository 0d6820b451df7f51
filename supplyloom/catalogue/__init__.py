"""Registered queries: every job on the relational test tables, with its SQL."""
