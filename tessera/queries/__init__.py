"""Every operator on the given tables through a fixed mapping, with SQL that gives the same rows."""

from . import fields, files, grids, records, vectors

QUERIES = {**grids.QUERIES, **fields.QUERIES, **vectors.QUERIES, **records.QUERIES, **files.QUERIES}
SQL = {**grids.SQL, **fields.SQL, **vectors.SQL, **records.SQL, **files.SQL}
