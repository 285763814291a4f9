"""keepsake — a PySpark library for saved-post catalogs.

Ingest semi-structured post captures, merge them into an id-keyed snapshot,
enrich pending rows with rules or user functions, and publish a by-tag catalog,
facets, search and listings — all as DataFrame plans that Catalyst optimises.
"""

from keepsake.schema import POST_SCHEMA, POST_FIELDS, conform_posts
from keepsake.session import build_session, scratch_dir

__all__ = ["POST_SCHEMA", "POST_FIELDS", "conform_posts", "build_session", "scratch_dir"]
