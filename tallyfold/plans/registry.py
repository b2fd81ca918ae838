"""All queries of the library and their SQL."""

from tallyfold.plans import models, records, rules, strokes  # noqa: F401

QUERIES, SQL = records.QUERIES, records.SQL
