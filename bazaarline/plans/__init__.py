"""Registered queries: operators applied to whole tables, each with its SQL where SQL can say it."""
