"""Registered queries of the library's own operators, each with SQL for a second engine where SQL can say it."""

from lodestone.queries import aggregates, filtering, jobs, ranking, scans, vectors  # noqa: F401
from lodestone.queries.registry import QUERIES, SQL  # noqa: F401
