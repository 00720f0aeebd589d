"""Every registered query."""

from pagelib.plans import content_queries, library_queries, log_queries, model_queries, planning_queries, search_queries, stream_queries, tag_queries, url_queries  # noqa: F401
from pagelib.plans.registry import QUERIES, SQL  # noqa: F401
