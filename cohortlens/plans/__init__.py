from cohortlens.plans.catalog import query_catalog, finalize
from cohortlens.plans.oracle import oracle_catalog

__all__ = ["query_catalog", "oracle_catalog", "finalize"]
