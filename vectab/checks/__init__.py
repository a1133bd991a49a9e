"""Queries over the given tables, with the SQL that must give the same rows."""

from . import analysis, scalars, tables

QUERIES = {**scalars.QUERIES, **tables.QUERIES, **analysis.QUERIES}
SQL = {**scalars.SQL, **tables.SQL, **analysis.SQL}
