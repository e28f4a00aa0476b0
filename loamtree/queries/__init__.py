"""The registered queries: each operator on the star-schema tables, and the same in SQL."""

from ..catalogue import ORACLE_SQL, QUERIES  # noqa: F401
from . import alignments, core, formats, genealogies, histories, streams, summaries, threads  # noqa: F401
from .core import interval_intersection_summary, sites  # noqa: F401
