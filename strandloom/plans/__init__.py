"""Registered queries."""

from strandloom.plans import inventory  # noqa: F401  these modules add their queries to the registry
from strandloom.plans import further  # noqa: F401
from strandloom.plans import closing  # noqa: F401
