"""Named queries; importing a module of queries registers them."""

from sparkloom.plans import further_queries, kv_queries, model_queries, relational_queries, surface_queries  # noqa: F401
