"""Evaluation of what a change touches, and of nothing else.

Whatever happens to batches, verifications or types names clusters and entities by key. Their rows of patterns and
memberships are computed anew from their own contributions and replace the stored ones; all others stay as they lie.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dealing import dealt
from ..sources.versions import Versioned
from . import membership


def touched_by_batches(assignments: DataFrame, batch_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and entities with an assignment (contribution_id, cluster_id, entity_id, import_batch_id) of the
    batches, whether it is active or not."""
    hit = assignments.join(batch_ids.select("import_batch_id").distinct(), "import_batch_id", "left_semi")
    return hit.select("cluster_id").distinct(), hit.select("entity_id").where("entity_id is not null").distinct()


def patterns(clusters: DataFrame, payments: DataFrame, rule: membership.Rule) -> DataFrame:
    return membership.cluster_pattern(clusters.select("cluster_id", "confidence_level"), payments, rule)


def memberships(entities: DataFrame, payments: DataFrame, rule: membership.Rule, coverage: membership.Coverage, day: date) -> DataFrame:
    own = entities.select("entity_id", "entity_type", "verification_status")
    return membership.membership_state(own, payments, rule, coverage, day)


def refresh_patterns(store: Versioned, changed: DataFrame, clusters: DataFrame, payments: DataFrame, rule: membership.Rule, run: int) -> list[int]:
    """Patterns of the changed clusters, merged into the store; a cluster that is gone loses its row.

    Payments are dealt before they meet the keys: a deal after that join is left out by Spark, as one by the same key, and
    a semi join would be moved ahead of it. The keys are distinct."""
    keys = changed.select("cluster_id").distinct()
    new = patterns(clusters.join(keys, "cluster_id", "left_semi"), dealt(payments, "cluster_id").join(keys, "cluster_id"), rule)
    return store.merge(keys, new, run)


def refresh_memberships(store: Versioned, changed: DataFrame, entities: DataFrame, payments: DataFrame, rule: membership.Rule, coverage: membership.Coverage, day: date, run: int) -> list[int]:
    """Memberships of the changed entities, merged into the store; an entity that is gone loses its row. Payments are dealt
    as in refresh_patterns()."""
    keys = changed.select("entity_id").distinct()
    new = memberships(entities.join(keys, "entity_id", "left_semi"), dealt(payments, "entity_id").join(keys, "entity_id"), rule, coverage, day)
    return store.merge(keys, new, run)


def reclassified(memberships_now: DataFrame, patterns_now: DataFrame, decisions: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, patterns) after corrections (entity_id, new_type): who is no person any more is UNKNOWN and
    INELIGIBLE, and the patterns of their clusters (cluster_id, entity_id) go."""
    lost = decisions.where("new_type <> 'INDIVIDUAL'").select("entity_id", F.col("new_type").alias("_type")).groupBy("entity_id").agg(F.max("_type").alias("_type"))
    hit = F.col("_type").isNotNull()
    status, pattern, authority = membership.STATES["S11"]
    rows = memberships_now.join(lost, "entity_id", "left").withColumns(
        {
            "calculated_status": F.when(hit, status).otherwise(F.col("calculated_status")), "recurrence_pattern_status": F.when(hit, pattern).otherwise(F.col("recurrence_pattern_status")),
            "membership_authority": F.when(hit, authority).otherwise(F.col("membership_authority")), "entity_type": F.coalesce("_type", "entity_type"),
        }
    )
    gone = clusters.join(lost.select("entity_id"), "entity_id", "left_semi").select("cluster_id").distinct()
    return rows.select(memberships_now.columns), patterns_now.join(gone, "cluster_id", "left_anti")
