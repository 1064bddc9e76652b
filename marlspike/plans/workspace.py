"""The workspace facade: entities and edges with the query families, one or a batch at a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..schema import ENTITY_KEY, OBJECT, SUBJECT

MOST_ITEMS = 32


@dataclass(frozen=True)
class Item:
    qid: str
    kind: str  # identity, name, forward, reverse, dependencies
    name: str
    domain: str | None = None
    entity_type: str | None = None
    depth: int = 1


class Workspace:
    def __init__(self, entities: DataFrame, edges: DataFrame, roots: list[str] | None = None):
        self.roots = graph.check_scope(roots or [])
        admit = lambda c: graph.admits(F.col(c), self.roots)
        self.entities, self.edges = entities.filter(admit("file")), graph.distinct_edges(edges.filter(admit("asserting_file")))

    def dependencies(self, *identity: str, depth: int = 1) -> DataFrame:
        return graph.closure(self.edges, identity, depth)

    def resolve(self, name: str, domain: str | None = None, entity_type: str | None = None) -> DataFrame:
        return graph.resolve_identity(self.entities, name, domain, entity_type)

    def cycle(self) -> list[tuple]:
        return graph.cycle_witness(self.edges)

    def batch(self, items: list[Item]) -> DataFrame:
        """qid, status, domain, entity_type, name, detail of up to 32 items with distinct ids.

        Items of a kind are one table joined once, so a batch costs a plan for each kind; an unknown kind is a row with
        status invalid and doesn't affect the others; no answer is a row with status not_found.
        """
        if not 1 <= len(items) <= MOST_ITEMS or len({i.qid for i in items}) != len(items):
            raise ValueError("a batch has 1 to 32 items with distinct ids")
        spark = self.entities.sparkSession
        schema = "qid string, kind string, q_name string, q_domain string, q_type string"
        asked = F.broadcast(spark.createDataFrame([(i.qid, i.kind, i.name, i.domain, i.entity_type) for i in items], schema))
        of = lambda *kinds: asked.filter(F.col("kind").isin(*kinds))
        fits = lambda d, t: (F.col("q_domain").isNull() | (F.col("q_domain") == F.col(d))) & (F.col("q_type").isNull() | (F.col("q_type") == F.col(t)))
        parts = [self.entities.join(of("identity", "name"), (F.col("name") == F.col("q_name")) & fits("domain", "entity_type")).select("qid", *ENTITY_KEY, F.col("file").alias("detail"))]
        for kind, own, other in (("forward", SUBJECT, OBJECT), ("reverse", OBJECT, SUBJECT)):
            hit = self.edges.join(of(kind), (F.col(own[2]) == F.col("q_name")) & fits(own[0], own[1]))
            parts.append(hit.select("qid", *(F.col(o).alias(e) for o, e in zip(other, ENTITY_KEY, strict=True)), F.col("relation").alias("detail")))
        for i in items:
            if i.kind == "dependencies" and i.domain and i.entity_type:
                parts.append(self.dependencies(i.domain, i.entity_type, i.name, depth=i.depth).select(F.lit(i.qid).alias("qid"), *ENTITY_KEY, F.col("depth").cast("string").alias("detail")))
        found = reduce(DataFrame.unionByName, parts)
        known = F.col("kind").isin("identity", "name", "forward", "reverse", "dependencies")
        return asked.select("qid", "kind").join(found, "qid", "left").select("qid", F.when(~known, "invalid").when(F.col("name").isNull(), "not_found").otherwise("ok").alias("status"), *ENTITY_KEY, "detail")
