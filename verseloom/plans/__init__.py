"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from verseloom.plans import relational_queries, scalar_queries, sequence_queries

QUERIES = {**scalar_queries.QUERIES, **relational_queries.QUERIES, **sequence_queries.QUERIES}
SQL = {**scalar_queries.SQL, **relational_queries.SQL}
