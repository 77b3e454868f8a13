"""All registered queries of the engine's own operators, with their SQL equivalents."""

from __future__ import annotations

from emberline.plans import catalog_plans, connector_plans, dedup_plans, evaluation_plans, feature_plans, labelling_plans, misc_plans, patent_plans, pool_plans, ranking_plans, relation_plans, rollup_plans, source_plans, spoken_plans, store_plans, text_plans  # noqa: F401
from emberline.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
