"""Registered queries over the test tables."""

from linkloom.queries import curation, discover, evidence, flagship, ingest, links, naming, watching  # noqa: F401
from linkloom.queries.registry import ORACLES, QUERIES  # noqa: F401
