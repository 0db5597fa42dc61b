"""All registered queries and their oracle SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from kestrel.plans import audit_queries, feature_queries, governance_queries, modeling_queries, product_queries, profile_queries, selection_queries, stream_queries, varied_queries
    out = {}
    for mod in (feature_queries, audit_queries, governance_queries, profile_queries, modeling_queries, product_queries,
                selection_queries, stream_queries, varied_queries):
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict:
    from kestrel.plans import audit_queries, feature_oracles, governance_queries, modeling_queries, product_queries, profile_queries, selection_queries, stream_queries, varied_queries
    out = {}
    for mod in (feature_oracles, audit_queries, governance_queries, profile_queries, modeling_queries, product_queries,
                selection_queries, stream_queries, varied_queries):
        out.update(mod.ORACLES)
    return out
