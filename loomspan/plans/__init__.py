"""Registered queries; importing this package registers them."""

from loomspan.plans import audit_queries, index_queries, inference_queries, interval_queries, model_queries, panel_queries, scalar_queries, serving_queries, split_queries, table_queries  # noqa: F401
