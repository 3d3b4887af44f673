"""The whole of a recall for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.operators import graph
from engrama.operators.recall import RETURNED, SEEDS, in_scope, recall


@dataclass(frozen=True)
class Options:
    returned: int = RETURNED
    seeds: int = SEEDS
    edge_k: int = 2
    edge_gate: float = 0.55
    mutual: bool = True
    hops: int = 1
    related_cap: int = 4
    constraint_gate: float = 0.45
    constraint_k: int = 2
    constraint_cap: int = 4
    field: bool = False


@dataclass(frozen=True)
class Recalled:
    """primary: (q_id, rnk, id, sim). related: (q_id, rnk, id, kind), empty unless the field is on."""

    primary: DataFrame
    related: DataFrame


def run(queries: DataFrame, memories: DataFrame, options: Options = Options(), ledger: DataFrame | None = None, within: str | None = None) -> Recalled:
    """Ranks each query's scope; with the field on, adds constraints that a seed is a near neighbour of, then the neighbourhood of the answer.

    queries: q_id, embedding, historical. Edges depend on the scope, so
    historical queries have their own graph. Ranking itself never looks at the ledger.
    within: a column of queries and memories that tells stores apart; ids must then be unique over all of them.
    """
    pool = recall(queries, memories, options.seeds, within)
    primary = pool.where(F.col("rnk") <= options.returned)
    related = None
    if options.field:
        for historical in (False, True):
            scope = in_scope(memories, historical)
            ask = queries.where(F.col("historical") == historical).select("q_id")
            got, seeds = primary.join(ask, "q_id", "left_semi"), pool.join(ask, "q_id", "left_semi")
            links = graph.edges(scope, options.edge_k, options.edge_gate, options.mutual, ledger, within)
            near = graph.neighbourhood(links, got, options.hops, options.related_cap)
            rescued = graph.constraint_rescue(scope, seeds, options.constraint_gate, options.constraint_k, options.constraint_cap, exclude=got, within=within)
            part = graph.merge_related(rescued, near, got)
            related = part if related is None else related.unionByName(part)
    if related is None:
        related = primary.select("q_id", "rnk", "id", F.lit("related").alias("kind")).where("false")
    return Recalled(primary, related)
