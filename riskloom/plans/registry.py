"""All registered queries and their SQL."""

from riskloom.plans import cohort, evaluation, learning

QUERIES: dict = cohort.QUERIES | evaluation.QUERIES | learning.QUERIES
SQL: dict = cohort.SQL | evaluation.SQL | learning.SQL
