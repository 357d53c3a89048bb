"""Identity: clusters, merges, amendments, verification."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..sources.scratch import forget, keep

LEVELS = ["LOW", "MEDIUM", "HIGH"]
EVIDENCE = ["suffix", "middle", "employer", "occupation"]


class _Block:
    """The clusters of one name and ZIP, found by what they show.

    A cluster shows at most one value of each kind of evidence (of middle names, one initial), or several where earlier
    members differ; those conflict with any row that has that kind. A row fits clusters that show, for each kind the
    row has, nothing or its own value, and at least one such value. So a row is at most fifteen look-ups, and each
    gives the oldest cluster of that kind; entries of clusters that have changed since are dropped when met.
    """

    def __init__(self):
        self.shown: list[list] = []  # of each cluster: value, None or _MIXED, for each kind of evidence
        self.middles: list[set[str]] = []
        self.ids: list[str] = []
        self.matched: list[int] = []
        self.heaps: dict[tuple, list[int]] = {}

    def new(self, cluster_id: str) -> int:
        self.shown.append([None] * len(EVIDENCE))
        self.middles.append(set())
        self.ids.append(cluster_id)
        self.matched.append(0)
        return len(self.ids) - 1

    def add(self, k: int, row: tuple) -> None:
        """Evidence of a row for cluster k."""
        shown, changed = self.shown[k], False
        for e, value in enumerate(row):
            if value:
                value = value[0] if e == _MIDDLE else value
                if shown[e] is None:
                    shown[e], changed = value, True
                elif shown[e] != value and shown[e] is not _MIXED:
                    shown[e], changed = _MIXED, True
        if row[_MIDDLE] and row[_MIDDLE] not in self.middles[k]:
            self.middles[k].add(row[_MIDDLE])
            changed = True
        if changed:
            for have in range(1, 1 << len(EVIDENCE)):
                for key in self._keys(k, have):
                    heapq.heappush(self.heaps.setdefault(key, []), k)

    def _keys(self, k: int, have: int):
        """Where rows with the kinds of evidence `have` find cluster k."""
        own = tuple(self.shown[k][e] if have >> e & 1 else None for e in range(len(EVIDENCE)))
        if all(v is None for v in own) or _MIXED in own:
            return
        if own[_MIDDLE] is not None and all(v is None for e, v in enumerate(own) if e != _MIDDLE):
            # the middle name alone: equal, or an initial on either side
            yield have, own, "initial of the row"
            for m in self.middles[k]:
                yield have, own, m if len(m) > 1 else "initial of the cluster"
        else:
            yield have, own, ""

    def find(self, row: tuple) -> int | None:
        """The oldest cluster that the row does not conflict with and is corroborated by."""
        have = sum(1 << e for e, v in enumerate(row) if v)
        values = [v[0] if v and e == _MIDDLE else v for e, v in enumerate(row)]
        best, part = None, have
        while part:
            own = tuple(values[e] if part >> e & 1 else None for e in range(len(EVIDENCE)))
            if part != 1 << _MIDDLE:
                tags = [""]
            elif len(row[_MIDDLE]) == 1:
                tags = ["initial of the row"]
            else:
                tags = [row[_MIDDLE], "initial of the cluster"]
            for tag in tags:
                heap = self.heaps.get((have, own, tag))
                while heap and (have, own, tag) not in self._keys(heap[0], have):
                    heapq.heappop(heap)
                if heap and (best is None or heap[0] < best):
                    best = heap[0]
            part = (part - 1) & have
        return best


_MIXED, _MIDDLE = object(), EVIDENCE.index("middle")


def _fold(batches):
    """Rows sorted by block, existing members first, then in order; only the clusters of the block under way are held."""
    key, block, known = None, _Block(), {}
    for batch in batches:
        batch = batch.fillna("")
        cols = [batch[c].tolist() for c in ("normalized_name", "zip5", "is_new", "cluster_id", "contribution_id", *EVIDENCE)]
        out = []
        for name, zip5, is_new, cluster_id, contribution_id, *row in zip(*cols, strict=True):
            if (name, zip5) != key:
                key, block, known = (name, zip5), _Block(), {}
            row = tuple(row)
            if not is_new:
                if cluster_id not in known:
                    known[cluster_id] = block.new(cluster_id)
                block.add(known[cluster_id], row)
                continue
            k = block.find(row)
            if k is None:
                k = block.new(contribution_id)
            else:
                block.matched[k] += 1
            block.add(k, row)
            out.append((contribution_id, block.ids[k], block.matched[k]))
        yield pd.DataFrame(out, columns=["contribution_id", "cluster_id", "matched_before"])


def cluster_contributions(rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(contribution_id, cluster_id, matched_before) of rows (contribution_id string, row_order, entity_type,
    normalized_name, zip5, suffix, middle, employer, occupation); members are earlier rows with their cluster_id.

    A new cluster has the id of its first contribution. Rows without any evidence match nothing and can be matched by
    nothing, so they are clusters of their own and never enter a block; neither do organisations and joint givers.
    """
    clean = rows.withColumns({e: F.upper(F.trim(F.coalesce(e, F.lit("")))) for e in EVIDENCE})
    bare = (F.col("entity_type") != "INDIVIDUAL") | (F.concat(*EVIDENCE) == "")
    alone = clean.where(bare).select("contribution_id", F.col("contribution_id").alias("cluster_id"), F.lit(0).cast("long").alias("matched_before"))
    blocks = clean.where(~bare).select("normalized_name", "zip5", "contribution_id", F.lit("").alias("cluster_id"), F.lit(1).alias("is_new"), "row_order", *EVIDENCE)
    if members is not None:
        known = members.withColumns({e: F.upper(F.trim(F.coalesce(e, F.lit("")))) for e in EVIDENCE})
        known = known.join(blocks.select("normalized_name", "zip5").distinct(), ["normalized_name", "zip5"], "left_semi")
        known = known.groupBy("normalized_name", "zip5", "cluster_id", *EVIDENCE).agg(F.min("row_order").alias("row_order"))
        blocks = blocks.unionByName(known.select("normalized_name", "zip5", F.lit("").alias("contribution_id"), "cluster_id", F.lit(0).alias("is_new"), "row_order", *EVIDENCE))
    block = ["normalized_name", "zip5"]
    folded = blocks.repartition(*block).sortWithinPartitions(*block, "is_new", "row_order").mapInPandas(_fold, "contribution_id string, cluster_id string, matched_before long")
    return alone.unionByName(folded)


def cluster_confidence(clustered: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The level of each cluster: its start (LOW) and one step up for each matched row."""
    matched = clustered.groupBy("cluster_id").agg(F.max("matched_before").alias("matched"))
    levels = F.array(*map(F.lit, LEVELS))
    first = F.lit(0)
    if start is not None:
        matched = matched.join(start.select("cluster_id", "confidence_level"), "cluster_id", "left")
        first = F.coalesce(F.array_position(levels, F.col("confidence_level")) - 1, F.lit(0))
    return matched.select("cluster_id", F.get(levels, F.least(first + F.col("matched"), F.lit(2)).cast("int")).alias("confidence_level"))


def derive_entities(clustered: DataFrame, rows: DataFrame) -> DataFrame:
    """An unverified entity for each new cluster, from its first row (contribution_id = cluster_id)."""
    first = clustered.where("contribution_id = cluster_id").select("contribution_id", "cluster_id")
    person = F.col("entity_type") == "INDIVIDUAL"
    pick = lambda c: F.when(person, F.col(c)).otherwise("")
    return rows.join(first, "contribution_id").select(
        "cluster_id", "entity_type", F.col("normalized_name").alias("display_name"), F.lit("UNVERIFIED").alias("verification_status"),
        pick("first").alias("first_name"), pick("middle").alias("middle_name"), pick("last").alias("last_name"), pick("suffix").alias("suffix"),
        F.when(~person, F.col("normalized_name")).alias("legal_name"),
    )


def derive_locations(rows: DataFrame) -> DataFrame:
    """One current location for each contribution."""
    street = F.coalesce("street", F.lit("")) != ""
    return rows.select(
        F.col("contribution_id").alias("location_id"), "cluster_id", "street", "city", "state", "zip", F.lit("CURRENT").alias("status"),
        F.when(street, "STREET").otherwise("CITY_ZIP").alias("precision"), F.when(street, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.col("transaction_date").alias("effective_date"),
    )


def merge_clusters(assignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Active assignments of a source move to its target, tagged with the decision; the old ones stay, inactive."""
    d = decisions.select("decision_id", F.col("source_cluster_id").alias("cluster_id"), "target_cluster_id")
    joined = assignments.join(d, "cluster_id", "left")
    moved = F.col("is_active") & F.col("target_cluster_id").isNotNull()
    old = joined.withColumn("is_active", F.col("is_active") & F.col("target_cluster_id").isNull()).select(assignments.columns)
    new = joined.where(moved).withColumns({"cluster_id": F.col("target_cluster_id"), "merge_decision_id": F.col("decision_id")}).select(assignments.columns)
    return old.unionByName(new)


def split_clusters(assignments: DataFrame, decision_ids: DataFrame) -> DataFrame:
    """Undoes decisions: their assignments go inactive, the latest earlier one of each contribution active."""
    hit = decision_ids.select(F.col("decision_id").alias("merge_decision_id")).distinct().withColumn("_undo", F.lit(True))
    rows = assignments.join(hit, "merge_decision_id", "left").withColumn("_undo", F.coalesce("_undo", F.lit(False)) & F.col("is_active"))
    per = Window.partitionBy("contribution_id")
    rows = rows.withColumn("_touched", F.max("_undo").over(per))
    rank = F.row_number().over(per.orderBy("_undo", F.desc("assigned_at"), F.desc("assignment_id")))
    active = F.when(F.col("_undo"), False).when(F.col("_touched") & (F.col("_rank") == 1), True).otherwise(F.col("is_active"))
    return rows.withColumn("_rank", rank).withColumn("is_active", active).select(assignments.columns)


def effective_contributions(contributions: DataFrame, amendments: DataFrame) -> DataFrame:
    """Without replacements of amendments that are pending or rejected, and originals of accepted ones."""
    gone = amendments.select(
        F.when(F.col("review_status") == "ACCEPTED", F.col("original_contribution_id"))
        .when(F.col("review_status").isin("PENDING", "REJECTED"), F.col("replacement_contribution_id"))
        .alias("contribution_id")
    )
    return contributions.join(gone.where("contribution_id is not null").distinct(), "contribution_id", "left_anti")


def effective_of(contributions: DataFrame, amendments: DataFrame, assignments: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """Effective contributions by key (cluster_id or entity_id, of the assignment): active assignments of completed
    batches only, numbered in order of date and id."""
    done = batches.where("status = 'COMPLETED'").select("import_batch_id")
    own = assignments.where("is_active").select("contribution_id", key)
    rows = effective_contributions(contributions.drop(key), amendments).join(own, "contribution_id").join(done, "import_batch_id", "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("transaction_date", "contribution_id")))


def _spread(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """nodes (node, value) with the largest value of all nodes that reach each along edges (u, v)."""
    last = None
    while True:
        came = edges.join(nodes.select(F.col("node").alias("u"), value), "u").groupBy(F.col("v").alias("node")).agg(F.max(value).alias("_came"))
        new = keep(nodes.join(came, "node", "left").select("node", F.greatest(value, "_came").alias(value), (F.col("_came") > F.col(value)).alias("_moved")), "spread")
        if last is not None:
            forget(last)
        moved, last, nodes = bool(new.where("_moved").take(1)), new, new.select("node", value)
        if not moved:
            return nodes


def _straightened(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chain, rings) of edges (u, v): chains of nodes with one edge in and one out become one edge each.

    chain: (node, head, tail) of the nodes that go; rings: (node, group) of cycles that consist of such nodes alone. Ends
    are found by pointer doubling, so that a chain of n takes log n rounds.
    """
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("v").alias("fore"))
    into = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("m"), F.min("u").alias("aft"))
    inner = keep(out.where("n = 1").join(into.where("m = 1"), "node").select("node", "fore", "aft"), "inner")
    ends = inner.select(F.col("node").alias("_x"))
    # a pointer that has left the chain stays; `low` is the smallest node passed, which names a ring
    far = lambda df, c, flag: df.join(ends.withColumnRenamed("_x", c), c, "left_semi").withColumn(flag, F.lit(True)).unionByName(df.join(ends.withColumnRenamed("_x", c), c, "left_anti").withColumn(flag, F.lit(False)))
    table = keep(far(far(inner, "fore", "going"), "aft", "coming").withColumn("low", F.least("node", F.when(F.col("going"), F.col("fore")).otherwise(F.col("node")))), "pointers")
    size, reach = inner.count(), 1
    while reach <= size and table.where("going or coming").take(1):
        ahead = table.select(F.col("node").alias("fore"), F.col("fore").alias("_fore"), F.col("going").alias("_going"), F.col("low").alias("_low"))
        back = table.select(F.col("node").alias("aft"), F.col("aft").alias("_aft"), F.col("coming").alias("_coming"))
        joined = table.join(ahead, "fore", "left").join(back, "aft", "left")
        step = joined.select(
            "node", F.coalesce("_fore", "fore").alias("fore"), F.coalesce("_aft", "aft").alias("aft"), F.coalesce("_going", F.lit(False)).alias("going"),
            F.coalesce("_coming", F.lit(False)).alias("coming"), F.least("low", "_low").alias("low"),
        )
        new = keep(step, "pointers")
        forget(table)
        table, reach = new, 2 * reach
    rings = table.where("going").select("node", F.col("low").alias("group"))
    chain = table.where("not going").select("node", F.col("aft").alias("head"), F.col("fore").alias("tail"))
    left = edges.join(ends.withColumnRenamed("_x", "u"), "u", "left_anti").join(ends.withColumnRenamed("_x", "v"), "v", "left_anti")
    return keep(left.select("u", "v").union(chain.select("head", "tail")).distinct(), "edges"), keep(chain, "chain"), keep(rings, "rings")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges less those whose start has no edge in or whose end none out, once."""
    inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return keep(inner.select("u", "v"), "edges")


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(node, group) of nodes on a cycle of edges (u, v); two of them have the same group if each reaches the other.

    Chains are straightened to single edges and loose ends cut off in turn, until nothing changes. What is left takes
    colors round by round: each node that of the largest node that reaches it; those of one color that also reach that
    node are a group. Then nodes of the chains get the group of both their ends, the last chains first.
    """
    loose = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("group")).distinct()
    edges, chains, found = keep(edges.where("u <> v").select("u", "v").distinct(), "edges"), [], []
    while (n := edges.count()) > 0:
        edges, chain, rings = _straightened(edges)
        chains.append(chain)
        found.append(rings)
        loose = loose.union(edges.where("u = v").select("u", "u"))
        edges = _trimmed(edges.where("u <> v"))
        if edges.count() == n:
            break
    while edges.take(1):
        nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
        color = _spread(nodes.withColumn("color", F.col("node")), edges, "color")
        own = edges.join(color.select(F.col("node").alias("u"), F.col("color").alias("cu")), "u").join(color.select(F.col("node").alias("v"), F.col("color").alias("cv")), "v").where("cu = cv")
        back = _spread(color.select("node", (F.col("node") == F.col("color")).cast("int").alias("root")), own.select(F.col("v").alias("u"), F.col("u").alias("v")), "root")
        group = keep(back.where("root = 1").join(color, "node").select("node", F.col("color").alias("group")), "groups")
        sizes = group.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        found.append(group.join(sizes, "group", "left_semi").select("node", "group"))
        done = group.select("node")
        rest = edges.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti")
        edges = _trimmed(rest.select("u", "v"))
    groups = reduce(DataFrame.union, found, edges.sparkSession.createDataFrame([], loose.schema))
    # a node with an edge to itself is its own group, unless a larger cycle has it
    groups = groups.union(loose.distinct().join(groups.select("node"), "node", "left_anti"))
    for chain in reversed(chains):
        at = lambda end: groups.select(F.col("node").alias(end), F.col("group").alias(f"_{end}"))
        on = chain.join(at("head"), "head").join(at("tail"), "tail").where("_head = _tail").select("node", F.col("_head").alias("group"))
        groups = keep(groups.union(on), "groups")
    return groups


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of nodes that reach themselves along edges (u, v)."""
    return cycle_groups(edges).select("node")


def validate_amendments(amendments: DataFrame) -> DataFrame:
    """(issue, contribution_id): self references, originals accepted twice, contributions on a cycle."""
    o, r = "original_contribution_id", "replacement_contribution_id"
    own = amendments.where(F.col(o) == F.col(r)).select(F.lit("SELF_REFERENCE").alias("issue"), F.col(o).alias("contribution_id"))
    twice = amendments.where("review_status = 'ACCEPTED'").groupBy(o).count().where("count > 1").select(F.lit("MULTIPLE_ACCEPTED").alias("issue"), F.col(o).alias("contribution_id"))
    edges = amendments.where(F.col(o) != F.col(r)).select(F.col(o).alias("u"), F.col(r).alias("v")).distinct()
    cycle = cycle_nodes(edges).select(F.lit("CYCLE").alias("issue"), F.col("node").alias("contribution_id"))
    return own.distinct().unionByName(twice).unionByName(cycle)


def verification_drift(entities: DataFrame) -> DataFrame:
    """Verified entities without a method or a verifier."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return entities.where((F.col("verification_status") == "VERIFIED") & (blank("verification_method") | blank("verified_by")))


def auto_verified(entities: DataFrame) -> DataFrame:
    """Entities that are verified by either field, with method NONE or nobody who verified them."""
    verified = F.col("is_verified") | (F.col("verification_status") == "VERIFIED")
    return entities.where(verified & ((F.col("verification_method") == "NONE") | F.col("verified_by").isNull()))


def drift_manifest(entities: DataFrame, clusters: DataFrame, assessments: DataFrame) -> DataFrame:
    """What correcting each auto-verified entity would change, without names: its clusters (sorted ids), its current
    assessment (of several the lowest id; none is UNKNOWN) and the fields before and as proposed."""
    own = auto_verified(entities)
    ids = clusters.join(own.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))
    now = assessments.where("is_current").groupBy("entity_id").agg(F.min_by(F.struct("assessment_id", "calculated_status"), "assessment_id").alias("_a"))
    said = {"proposed_verification_status": "UNVERIFIED", "proposed_verification_method": "NONE", "proposed_membership_authority": "PROVISIONAL", "reason_code": "INVALID_CLUSTER_CONFIDENCE_AUTOVERIFICATION"}
    return own.join(ids, "entity_id", "left").join(now, "entity_id", "left").select(
        "entity_id", "entity_type", F.col("is_verified").alias("previous_is_verified"), F.col("verification_status").alias("previous_verification_status"),
        F.col("verification_method").alias("previous_verification_method"), F.coalesce("cluster_ids", F.array().cast(ids.schema["cluster_ids"].dataType)).alias("cluster_ids"),
        F.col("_a.assessment_id").alias("current_assessment_id"), F.coalesce("_a.calculated_status", F.lit("UNKNOWN")).alias("current_assessment_status"), *[F.lit(v).alias(k) for k, v in said.items()],
    )


def _told(row: str, fields: list[str]) -> Column:
    """A struct's fields as one text; null is told apart from empty."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.coalesce(F.concat(F.lit("'"), F.col(f"{row}.{f}").cast("string"), F.lit("'")), F.lit("null"))) for f in fields])


def change_records(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, before, after, changed_fields, checksum) of rows that differ in some field; both sides have each key at
    most once. before and after are structs of the fields; the checksum is over key and both texts."""
    rows = before.select(key, F.struct(*fields).alias("before")).join(after.select(key, F.struct(*fields).alias("after")), key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]))
    text = F.concat_ws("||", F.col(key).cast("string"), _told("before", fields), _told("after", fields))
    return rows.withColumn("changed_fields", changed).where(F.size("changed_fields") > 0).withColumn("checksum", F.sha2(text, 256))


def inverted(records: DataFrame, key: str) -> DataFrame:
    """Records that undo the given ones."""
    fields = records.schema["before"].dataType.fieldNames()
    text = F.concat_ws("||", F.col(key).cast("string"), _told("before", fields), _told("after", fields))
    return records.select(key, F.col("after").alias("before"), F.col("before").alias("after"), "changed_fields").withColumn("checksum", F.sha2(text, 256))


def apply_changes(table: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with the records applied, records turned down with a reason).

    A record counts only if its checksum fits (else CHECKSUM), its row is there (else MISSING) and has the values from
    before (else MOVED_ON). Applying records and then their inverse leaves the table as it was."""
    fields = records.schema["before"].dataType.fieldNames()
    text = F.concat_ws("||", F.col(key).cast("string"), _told("before", fields), _told("after", fields))
    now = table.select(key, F.struct(*fields).alias("_now"), F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, [F.col(f"_now.{f}").eqNullSafe(F.col(f"before.{f}")) for f in fields])
    reason = F.when(F.sha2(text, 256) != F.col("checksum"), "CHECKSUM").when(F.col("_there").isNull(), "MISSING").when(~same, "MOVED_ON")
    judged = records.join(now, key, "left").withColumn("reason", reason)
    good = judged.where("reason is null").select(key, F.col("after").alias("_to"), F.lit(True).alias("_hit"))
    rows = table.join(good, key, "left")
    out = rows.withColumns({f: F.when(F.col("_hit"), F.col(f"_to.{f}")).otherwise(F.col(f)) for f in fields}).select(table.columns)
    return out, judged.where("reason is not null").select(*records.columns, "reason")


def apply_unverification(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities with the given ones reset."""
    rows = entities.join(ids.select("entity_id").distinct().withColumn("_hit", F.lit(True)), "entity_id", "left")
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {"verification_status": F.when(F.col("_hit"), "UNVERIFIED").otherwise(F.col("verification_status"))}
        | {c: F.when(F.col("_hit"), none).otherwise(F.col(c)) for c in ("verification_method", "verified_by")}
    ).select(entities.columns)


def apply_verification_rollback(entities: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entities with the verification of the manifest (entity_id, verification_status, verification_method,
    verified_by, verified_at; one row for an entity); VERIFIED without a method is LEGACY_REVIEWED, without a time of
    2026-01-01. Entities get the fields that they have."""
    verified, method = F.coalesce("verification_status", F.lit("UNVERIFIED")) == "VERIFIED", F.coalesce("verification_method", F.lit("NONE"))
    values = {
        "verification_status": F.coalesce("verification_status", F.lit("UNVERIFIED")),
        "verification_method": F.when(verified & (method == "NONE"), "LEGACY_REVIEWED").otherwise(method),
        "verified_by": F.col("verified_by"),
        "verified_at": F.when(verified, F.coalesce(F.col("verified_at").cast("timestamp"), F.lit("2026-01-01T00:00:00Z").cast("timestamp"))).otherwise(F.col("verified_at").cast("timestamp")),
    }
    restored = manifest.select("entity_id", F.struct(*[v.alias(c) for c, v in values.items()]).alias("_to"))
    rows = entities.join(restored, "entity_id", "left")
    return rows.withColumns({c: F.when(F.col("_to").isNotNull(), F.col(f"_to.{c}")).otherwise(F.col(c)) for c in values if c in entities.columns}).select(entities.columns)


# Methods of verification, and evidence keys that name a person.
METHODS = ["ADMIN_REVIEW", "EXTERNAL_IDENTITY_MATCH", "LEGACY_REVIEWED"]
PERSONAL_KEYS = ["first_name", "last_name", "name", "street", "address", "email", "phone", "ssn"]


def check_verifications(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of decisions (entity_id, method, explanation, evidence map).

    A match with an external source needs source_type and source_version in its evidence, and no key there that names a
    person; every method needs an explanation."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    external = F.col("method") == "EXTERNAL_IDENTITY_MATCH"
    missing = F.lit(False)
    for key in ("source_type", "source_version"):
        missing = missing | (F.coalesce(F.try_element_at("evidence", F.lit(key)), F.lit("")) == "")
    personal = F.exists(F.coalesce(F.map_keys("evidence"), F.array().cast("array<string>")), lambda k: F.lower(k).isin(PERSONAL_KEYS))
    reason = (
        F.when(~F.coalesce(F.col("method").isin(METHODS), F.lit(False)), "method")
        .when(external & missing, "source")
        .when(external & personal, "personal evidence")
        .when(blank("explanation"), "explanation")
    )
    rows = decisions.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def apply_verifications(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with the accepted decisions (with verified_by and verified_at), of each entity the latest one."""
    fields = {"verification_method": "method", "verified_by": "verified_by", "verified_at": "verified_at", "verification_explanation": "explanation"}
    latest = check_verifications(decisions)[0].groupBy("entity_id").agg(F.max_by(F.struct(*[F.col(c).alias(f) for f, c in fields.items()]), "verified_at").alias("_v"))
    rows = entities.join(latest, "entity_id", "left")
    hit = F.col("_v").isNotNull()
    values = {"verification_status": F.when(hit, "VERIFIED").otherwise(F.col("verification_status"))}
    values |= {f: F.when(hit, F.col(f"_v.{f}")).otherwise(F.col(f)) for f in fields if f in entities.columns}
    return rows.withColumns(values).select(entities.columns)


def reclassify_entities(entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, rejected decisions) of type corrections (entity_id, new_type, reason).

    A person gets name parts from display_name; anything else loses them, and membership_status becomes UNKNOWN.
    A decision without a reason is rejected."""
    good = F.coalesce(F.trim("reason"), F.lit("")) != ""
    d = decisions.where(good).groupBy("entity_id").agg(F.max("new_type").alias("_type"))
    rows = entities.join(d, "entity_id", "left").withColumn("_p", normalize_name(F.col("display_name")))
    person = F.col("_type") == "INDIVIDUAL"
    none = F.lit(None).cast("string")
    parts = {f"{c}_name": F.when(person, F.col(f"_p.{c}")).when(F.col("_type").isNotNull(), none).otherwise(F.col(f"{c}_name")) for c in ("first", "middle", "last")}
    status = F.when(F.col("_type").isNotNull() & ~person, "UNKNOWN").otherwise(F.col("membership_status"))
    out = rows.withColumns(parts | {"membership_status": status, "entity_type": F.coalesce("_type", "entity_type")})
    return out.select(entities.columns), decisions.where(~good)
