"""All registered queries (importing a module registers its queries)."""

from webloom.plans import (  # noqa: F401
    crawl_queries,
    dataset_queries,
    flow_queries,
    job_queries,
    page_queries,
    storage_queries,
    stream_queries,
    text_queries,
    url_queries,
)
from webloom.plans.registry import ORACLES, QUERIES  # noqa: F401
