"""Queries of the library; catalog has them all once this package is imported."""

from . import catalog, encodings, hosts, investigation, matching, scanning, stores  # noqa: F401
