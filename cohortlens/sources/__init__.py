from cohortlens.sources.tables import (TABLES, read_table, read_csv, write_table,
                                      schema_report)
from cohortlens.sources.profile import (order_profile, doc_scores, ORDER_CATEGORICALS,
                                       ORDER_NUMERICS, EMPLOYEE_SCHEMA)

__all__ = ["TABLES", "read_table", "read_csv", "write_table", "schema_report",
           "order_profile", "doc_scores", "ORDER_CATEGORICALS", "ORDER_NUMERICS",
           "EMPLOYEE_SCHEMA"]
