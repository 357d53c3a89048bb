"""Recurrence and membership."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import dealt


@dataclass(frozen=True)
class Rule:
    """M8: the rule in force; these are the defaults where no rule is active."""

    monthly_interval_min: int = 20
    monthly_interval_max: int = 40
    active_grace_period: int = 60
    min_recurring_payments: int = 2
    skip_payment_allowed: bool = True
    rule_version_id: int | None = None


@dataclass(frozen=True)
class Coverage:
    """M7: how far the data reach; stale over 60 days, or if it isn't known to be complete."""

    through: date
    status: str = "CONFIRMED_COMPLETE"

    def age(self, day: date) -> int:
        return (day - self.through).days

    def stale(self, day: date) -> bool:
        return self.age(day) > 60 or self.status not in ("CONFIRMED_COMPLETE", "APPARENTLY_CONTINUOUS")


def active_rule(rules: DataFrame) -> Rule:
    """M8: the first active rule by id, or the defaults. A lookup of one row."""
    row = rules.where("is_active").orderBy("rule_version_id").limit(1).collect()
    return Rule(*(row[0][f] for f in Rule.__dataclass_fields__)) if row else Rule()


def active_coverage(coverages: DataFrame) -> Coverage | None:
    """M8: the coverage with the latest end. A lookup of one row."""
    row = coverages.orderBy(F.desc("coverage_end_date")).limit(1).collect()
    return Coverage(row[0]["coverage_end_date"], row[0]["coverage_status"]) if row else None


def in_force(rules: DataFrame, coverages: DataFrame) -> DataFrame:
    """M8: the rule and the coverage that evaluations take, as one row that stays on the cluster. Where no rule is active
    or no coverage is known, the defaults and nulls."""
    fields = [f for f in Rule.__dataclass_fields__]
    rule = rules.where("is_active").agg(F.min_by(F.struct(*fields), "rule_version_id").alias("_r"))
    coverage = coverages.agg(F.max_by(F.struct("coverage_end_date", "coverage_status"), "coverage_end_date").alias("_c"))
    default = Rule()
    return rule.crossJoin(coverage).select(  # two single rows
        *[F.when(F.col("_r").isNull(), F.lit(getattr(default, f))).otherwise(F.col(f"_r.{f}")).alias(f) for f in fields],
        F.col("_c.coverage_end_date").alias("through"), F.col("_c.coverage_status").alias("status"),
    )


def active_contributions(contributions: DataFrame, assignments: DataFrame, batches: DataFrame) -> DataFrame:
    """M1: contributions with an active assignment, of completed batches; cluster_id comes from the assignment."""
    done = batches.where("status = 'COMPLETED'").select("import_batch_id")
    own = assignments.where("is_active").select("contribution_id", "cluster_id")
    return contributions.drop("cluster_id").join(own, "contribution_id").join(done, "import_batch_id", "left_semi")


def net_payments(payments: DataFrame, key: str) -> DataFrame:
    """M2: (key, transaction_date, net): contributions less all else of a day, where that is over zero.

    Payments are dealt by key, so that intervals and counts by key need no other shuffle."""
    signed = F.when(F.col("transaction_type") == "CONTRIBUTION", F.col("amount")).otherwise(-F.abs("amount"))
    return dealt(payments.select(key, "transaction_date", "transaction_type", "amount"), key).groupBy(key, "transaction_date").agg(F.sum(signed).alias("net")).where("net > 0")


def payment_intervals(net: DataFrame, key: str) -> DataFrame:
    """M3: net with gap, the days since the payment before (null for the first)."""
    return net.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(Window.partitionBy(key).orderBy("transaction_date"))))


def _gap_kinds(rule: Rule):
    valid = F.col("gap").between(rule.monthly_interval_min, rule.monthly_interval_max)
    skipped = ~valid & F.col("gap").between(50, 80) & F.lit(rule.skip_payment_allowed)
    return valid, skipped


def recurrence_counts(net: DataFrame, key: str, rule: Rule = Rule()) -> DataFrame:
    """M4 and the aggregates that M5 and M6 need; one row for each key with a net payment."""
    valid, skipped = _gap_kinds(rule)
    # a payment without a third one after it is of the last three; one order of a key's payments serves both columns
    third = F.lead("transaction_date", 3).over(Window.partitionBy(key).orderBy("transaction_date"))
    return (
        payment_intervals(net, key)
        .withColumn("_third", third)
        .groupBy(key)
        .agg(
            F.count("*").alias("n_payments"),
            F.count_if(valid).alias("valid_gaps"),
            F.count_if(skipped).alias("skipped_gaps"),
            F.count_if(F.col("gap").isNotNull() & ~valid & ~skipped).alias("other_gaps"),
            F.max("transaction_date").alias("last_payment"),
            F.sum(F.when(F.col("_third").isNull(), F.col("net"))).alias("last_three"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("transaction_date", "gap")))), lambda x: x["gap"]).alias("interval_days"),
        )
        .withColumn("is_recurring", F.col("valid_gaps") + F.col("skipped_gaps") >= rule.min_recurring_payments - 1)
    )


def cluster_pattern(clusters: DataFrame, payments: DataFrame, rule: Rule = Rule(), evaluation_date: date | None = None) -> DataFrame:
    """M5: pattern of every cluster (cluster_id, confidence_level). Without a date a cluster is judged at its last payment."""
    counts = recurrence_counts(net_payments(payments, "cluster_id"), "cluster_id", rule)
    day = F.lit(evaluation_date) if evaluation_date else F.col("last_payment")
    recent = F.datediff(day, F.col("last_payment")) <= rule.active_grace_period
    n = F.coalesce("n_payments", F.lit(0))
    return clusters.join(counts, "cluster_id", "left").select(
        "cluster_id",
        F.when(n == 0, "INSUFFICIENT_HISTORY")
        .when(n == 1, "SINGLE_VISIBLE_CONTRIBUTION")
        .when(F.col("is_recurring") & recent, "POSSIBLE_RECURRING")
        .when(F.col("is_recurring"), "PREVIOUSLY_RECURRING")
        .when(F.col("confidence_level") == "LOW", "AMBIGUOUS_IDENTITY_CLUSTER")
        .otherwise("INSUFFICIENT_HISTORY")
        .alias("pattern"),
        n.alias("n_payments"),
        F.coalesce("valid_gaps", F.lit(0)).alias("valid_gaps"),
        F.coalesce("skipped_gaps", F.lit(0)).alias("skipped_gaps"),
    )


# Membership states by id: status, pattern, authority.
STATES = {
    "S01": ("ACTIVE", "RECURRING_PATTERN", "AUTHORITATIVE"),
    "S02": ("PREVIOUSLY_RECURRING", "RECURRING_PATTERN", "AUTHORITATIVE"),
    "S03": ("LAPSED", "RECURRING_PATTERN", "AUTHORITATIVE"),
    "S04": ("ONE_TIME", "NO_RECURRING_PATTERN", "AUTHORITATIVE"),
    "S05": ("DATASET_TOO_STALE", "NO_RECURRING_PATTERN", "AUTHORITATIVE"),
    "S06": ("INSUFFICIENT_HISTORY", "IRREGULAR_PATTERN", "AUTHORITATIVE"),
    "S07": ("PROVISIONAL", "RECURRING_PATTERN", "PROVISIONAL"),
    "S08": ("UNKNOWN", "IRREGULAR_PATTERN", "PROVISIONAL"),
    "S09": ("PROVISIONAL", "INSUFFICIENT_HISTORY", "PROVISIONAL"),
    "S10": ("UNKNOWN", "INSUFFICIENT_HISTORY", "PROVISIONAL"),
    "S11": ("UNKNOWN", "INSUFFICIENT_HISTORY", "INELIGIBLE"),
}


# What is said of each state; S11 names the type.
EXPLANATIONS = {
    "S01": "Verified recurring donor with recent payment.",
    "S02": "Verified recurring donor, no recent payment, stale coverage.",
    "S03": "Verified recurring donor, no recent payment, current coverage.",
    "S04": "Single verified contribution with current coverage.",
    "S05": "Single verified contribution but dataset is stale.",
    "S06": "Verified irregular donor.",
    "S07": "Unverified recurring donor.",
    "S08": "Unverified irregular donor.",
    "S09": "Single unverified contribution.",
    "S10": "No net positive contributions found.",
    "S11": "Entity type %s is ineligible for membership.",
}


def state_of(kind: Column, verified: Column, n: Column, recurring: Column, recent: Column, stale: Column) -> Column:
    """M6: the id of the state that these facts make."""
    return (
        F.when(kind.isin("ORGANIZATION", "JOINT", "UNKNOWN"), "S11")
        .when(n == 0, "S10")
        .when((n == 1) & verified & ~stale, "S04")
        .when((n == 1) & verified, "S05")
        .when(n == 1, "S09")
        .when(recurring & verified & recent, "S01")
        .when(recurring & verified & stale, "S02")
        .when(recurring & verified, "S03")
        .when(recurring, "S07")
        .when(verified, "S06")
        .otherwise("S08")
    )


def _named(state: Column) -> Column:
    """(status, pattern, authority) of a state."""
    return F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[state]


def explanation(state: Column, kind: Column) -> Column:
    """M6: what is said of a state. From its id alone, so that no text goes through a shuffle before it is shown."""
    said = F.create_map(*[x for kv in EXPLANATIONS.items() for x in map(F.lit, kv)])[state]
    return F.when(state == "S11", F.format_string(EXPLANATIONS["S11"], kind)).otherwise(said)


def _mean(last_three: Column, n: Column) -> Column:
    return F.bround(last_three.cast("decimal(20,2)") / F.least(n, F.lit(3)), 2)


def membership_state(entities: DataFrame, payments: DataFrame, rule: Rule, coverage: Coverage, evaluation_date: date) -> DataFrame:
    """M6: the state of every entity (entity_id, entity_type, verification_status) from payments keyed by entity_id."""
    counts = recurrence_counts(net_payments(payments, "entity_id"), "entity_id", rule)
    totals = payments.groupBy("entity_id").agg(F.count("*").alias("contribution_count"), F.count_if(F.col("transaction_type") != "CONTRIBUTION").alias("refund_count"))
    rows = entities.join(counts, "entity_id", "left").join(totals, "entity_id", "left")
    n, verified = F.coalesce("n_payments", F.lit(0)), F.col("verification_status") == "VERIFIED"
    recent = F.datediff(F.lit(evaluation_date), F.col("last_payment")) <= rule.active_grace_period
    stale = F.lit(coverage.stale(evaluation_date))
    state = state_of(F.col("entity_type"), verified, n, F.col("is_recurring"), recent, stale)
    rows = rows.withColumn("state_id", state).withColumn("_s", _named(F.col("state_id")))
    regular = F.col("_s")[1] == "RECURRING_PATTERN"
    eligible = F.col("state_id") != "S11"
    mean = _mean(F.col("last_three"), F.col("n_payments"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "entity_id",
        "entity_type",
        "verification_status",
        "state_id",
        F.col("_s")[0].alias("calculated_status"),
        F.col("_s")[1].alias("recurrence_pattern_status"),
        F.col("_s")[2].alias("membership_authority"),
        F.when(regular, mean).otherwise(F.lit(0)).cast("decimal(12,2)").alias("recurring_amount"),
        F.when(regular, "Monthly").otherwise("None").alias("payment_interval"),
        F.coalesce("contribution_count", zero).alias("contribution_count"),
        F.coalesce("refund_count", zero).alias("refund_count"),
        F.when(eligible, n).otherwise(0).cast("long").alias("positive_count"),
        F.when(eligible, F.lit(coverage.age(evaluation_date))).alias("coverage_age_days"),
        F.when(eligible & F.col("interval_days").isNotNull(), F.col("interval_days")).otherwise(F.array().cast("array<int>")).alias("interval_days"),
    )


def consistent() -> Column:
    """M9: whether is_verified says what status and method say; a null method is one, NONE is none."""
    return F.col("is_verified") == ((F.col("verification_status") == "VERIFIED") & (F.coalesce("verification_method", F.lit("")) != "NONE"))


def assess_entities(current: DataFrame, states: DataFrame, calculation_date: date, inconsistent: DataFrame | None = None, rule: Rule = Rule()) -> DataFrame:
    """M9: the assessment history with new rows appended and older rows of the same entities no longer current.

    states: of membership_state(). Entities of `inconsistent` (entity_id) get an UNKNOWN, PROVISIONAL row instead, which
    says why. New rows carry the rule and whether the identity was verified.
    """
    day, version = F.lit(calculation_date).alias("calculation_date"), F.lit(rule.rule_version_id).cast("long").alias("rule_version_id")
    new = states
    if inconsistent is not None:
        new = new.join(inconsistent.select("entity_id"), "entity_id", "left_anti")
    new = new.select(
        "entity_id", "calculated_status", "recurrence_pattern_status", "membership_authority", (F.col("verification_status") == "VERIFIED").alias("identity_verified_at_assessment"),
        "recurring_amount", "payment_interval", explanation(F.col("state_id"), F.col("entity_type")).alias("explanation"), day, version, F.lit(True).alias("is_current"),
    )
    if inconsistent is not None:
        odd = inconsistent.select(
            "entity_id", F.lit("UNKNOWN").alias("calculated_status"), F.lit("INSUFFICIENT_HISTORY").alias("recurrence_pattern_status"), F.lit("PROVISIONAL").alias("membership_authority"),
            F.lit(False).alias("identity_verified_at_assessment"), F.lit("Verification field inconsistency detected.").alias("explanation"), day, version, F.lit(True).alias("is_current"),
        )
        new = new.unionByName(odd, allowMissingColumns=True)
    done = new.select("entity_id").distinct().withColumn("_new", F.lit(True))
    old = current.join(done, "entity_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new, allowMissingColumns=True)


def membership_predicates(states: DataFrame) -> DataFrame:
    """M10."""
    kind, verified, status = F.col("entity_type") == "INDIVIDUAL", F.col("verification_status"), F.col("calculated_status")
    pattern, authority = F.col("recurrence_pattern_status"), F.col("membership_authority")
    return states.select(
        "entity_id",
        (kind & (verified == "VERIFIED") & (status == "ACTIVE") & (pattern == "RECURRING_PATTERN") & (authority == "AUTHORITATIVE")).alias("is_current_member"),
        (kind & (verified == "UNVERIFIED") & (status == "PROVISIONAL") & (pattern == "RECURRING_PATTERN") & (authority == "PROVISIONAL")).alias("is_provisional_possible"),
        (kind & (status == "PREVIOUSLY_RECURRING")).alias("is_previously_recurring"),
        (kind & (status == "LAPSED")).alias("is_lapsed"),
        (kind & (status == "ONE_TIME")).alias("is_one_time"),
        (authority == "INELIGIBLE").alias("is_ineligible"),
    )


def latest_assessment(assessments: DataFrame) -> DataFrame:
    """Of each entity the row with the newest calculation_date, then the largest id; by aggregation, not by a sort."""
    rest = [c for c in assessments.columns if c != "entity_id"]
    return assessments.groupBy("entity_id").agg(F.max_by(F.struct(*rest), F.struct("calculation_date", "assessment_id")).alias("_a")).select("entity_id", "_a.*")


def apply_membership_overrides(assessments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual rows (entity_id, status, calculation_date) become current, with amount 0 and interval Manual."""
    new = overrides.select(
        "entity_id", F.col("status").alias("calculated_status"), "calculation_date", F.lit(True).alias("is_current"),
        F.lit(0).cast("decimal(12,2)").alias("recurring_amount"), F.lit("Manual").alias("payment_interval"), F.lit(True).alias("manual_override"),
    )
    old = assessments.join(overrides.select("entity_id").distinct().withColumn("_new", F.lit(True)), "entity_id", "left")
    return old.withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new").unionByName(new, allowMissingColumns=True)


def matrix_state(kind: Column, verified: Column, status: Column, pattern: Column, authority: Column) -> Column:
    """The first allowed state that fits, or UNMATCHED. The matrix has a dozen rows, so it is an expression."""
    out = None
    for k, (m_status, m_pattern, m_authority) in STATES.items():
        kinds = ["ORGANIZATION", "JOINT", "UNKNOWN"] if k == "S11" else ["INDIVIDUAL"]
        fits = kind.isin(kinds) & (status == m_status) & (pattern == m_pattern) & (authority == m_authority)
        if k not in ("S10", "S11"):
            fits = fits & (verified == ("UNVERIFIED" if k in ("S07", "S08", "S09") else "VERIFIED"))
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out.otherwise("UNMATCHED")


def audit_matrix(states: DataFrame) -> DataFrame:
    """The first allowed state that fits each row, or UNMATCHED."""
    fields = ("entity_type", "verification_status", "calculated_status", "recurrence_pattern_status", "membership_authority")
    return states.select("entity_id", matrix_state(*map(F.col, fields)).alias("matrix_id"))


# Least and largest number of positive contributions of a state; S11 has no bounds.
COUNTS = {"S01": (2, None), "S02": (2, None), "S03": (2, None), "S04": (1, 1), "S05": (1, 1), "S06": (2, None), "S07": (2, None), "S08": (2, None), "S09": (1, 1), "S10": (0, 0)}


def count_violation(state: Column, n: Column) -> Column:
    """Whether a state has too few or too many positive contributions."""
    out = [(state == k) & ((n < low) if high is None else ~n.between(low, high)) for k, (low, high) in COUNTS.items()]
    return reduce(lambda a, b: a | b, out)


def evidence_violations(matched: DataFrame, positives: DataFrame) -> DataFrame:
    """Rows of audit_matrix() whose entity has too few or too many positive contributions (entity_id,
    positive_count, of all its contributions) for the state; an entity without a row has none."""
    met = matched.join(positives, "entity_id", "left").withColumn("positive_count", F.coalesce("positive_count", F.lit(0)))
    return met.where(count_violation(F.col("matrix_id"), F.col("positive_count"))).select("entity_id", "matrix_id", "positive_count")


# Combinations that no state may have: field -> values.
REJECTED = {
    "R01": {"calculated_status": ["ACTIVE"], "membership_authority": ["PROVISIONAL", "INELIGIBLE"]},
    "R02": {"calculated_status": ["ACTIVE"], "recurrence_pattern_status": ["INSUFFICIENT_HISTORY"]},
    "R03": {"calculated_status": ["PROVISIONAL"], "membership_authority": ["AUTHORITATIVE"]},
    "R04": {"entity_type": ["ORGANIZATION", "JOINT", "UNKNOWN"], "membership_authority": ["AUTHORITATIVE", "PROVISIONAL"]},
    "R05": {"verification_status": ["UNVERIFIED"], "membership_authority": ["AUTHORITATIVE"]},
    "R06": {"calculated_status": ["ACTIVE", "PREVIOUSLY_RECURRING", "LAPSED"], "recurrence_pattern_status": ["INSUFFICIENT_HISTORY"]},
}


def rejected_combinations(states: DataFrame) -> DataFrame:
    """(entity_id, rule_id) for every rule that a state breaks."""
    hit = [F.when(reduce(lambda a, b: a & b, [F.col(f).isin(v) for f, v in fields.items()]), F.lit(k)) for k, fields in REJECTED.items()]
    return states.select("entity_id", F.explode(F.array_compact(F.array(*hit))).alias("rule_id"))


DIFF_FIELDS = ["calculated_status", "recurrence_pattern_status", "membership_authority", "recurring_amount", "payment_interval", "rule_version_id"]


def _plain(side: str, field: str) -> Column:
    """A field as it is compared: null, empty and None are the same, amounts count to two places with null as 0."""
    c = F.col(f"{side}.{field}")
    if field == "recurring_amount":
        return F.coalesce(c, F.lit(0)).cast("decimal(12,2)").cast("string")
    c = c.cast("string")
    return F.when(c.isNull() | c.isin("", "None"), F.lit(None)).otherwise(c)


def audit_recompute(stored: DataFrame, computed: DataFrame, key: str = "entity_id", fields: list[str] = DIFF_FIELDS) -> DataFrame:
    """(key, changed_fields, before, after) of stored rows against computed ones."""
    joined = stored.alias("s").join(computed.alias("c"), key)
    changed = F.array_compact(F.array(*[F.when(~_plain("s", f).eqNullSafe(_plain("c", f)), F.lit(f)) for f in fields]))
    return joined.select(key, changed.alias("changed_fields"), F.col("s.calculated_status").alias("before"), F.col("c.calculated_status").alias("after"))


def states_at(requests: DataFrame, payments: DataFrame, rules: DataFrame, coverage: Coverage) -> DataFrame:
    """States as they are under a rule and on a day of their own.

    requests: (request_id, entity_id, entity_type, verification_status, rule_version_id, evaluation_date, upto); payments
    after `upto` don't count, null means all do. rules: (rule_version_id, thresholds), a dimension of a few rows.

    An as-of join: payments of an entity carry running counts under each rule that its requests name, and a request takes
    those of the last payment not after its day. Requests and payments of an entity and rule are sorted once, so that an
    entity with many of both costs their sum, not their product.
    """
    far = F.lit("9999-12-31").cast("date")
    asked = requests.withColumn("_day", F.coalesce("upto", far))
    wanted = asked.select("entity_id", "rule_version_id").distinct().join(rules, "rule_version_id")
    line = Window.partitionBy("entity_id", "rule_version_id").orderBy("transaction_date")
    valid = F.col("gap").between(F.col("monthly_interval_min"), F.col("monthly_interval_max"))
    running = (
        payment_intervals(net_payments(payments, "entity_id"), "entity_id")
        .join(wanted, "entity_id")
        .withColumn("_regular", F.when(valid | (F.col("skip_payment_allowed") & F.col("gap").between(50, 80)), 1).otherwise(0))
        .select(
            "entity_id", "rule_version_id", F.col("transaction_date").alias("_day"), F.lit(0).alias("_kind"),
            F.struct(
                F.row_number().over(line).alias("n"), F.sum("_regular").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("regular"),
                F.sum("net").over(line.rowsBetween(-2, 0)).cast("decimal(22,2)").alias("last_three"), F.col("transaction_date").alias("last_payment"),
            ).alias("_facts"),
        )
    )
    both = running.unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("entity_id", "rule_version_id").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_facts", F.last("_facts", ignorenulls=True).over(order)).where("_kind = 1").join(rules, "rule_version_id")
    n, verified = F.coalesce("_facts.n", F.lit(0)), F.col("verification_status") == "VERIFIED"
    recurring = F.col("_facts.regular") >= F.col("min_recurring_payments") - 1
    recent = F.datediff("evaluation_date", "_facts.last_payment") <= F.col("active_grace_period")
    age = F.datediff("evaluation_date", F.lit(coverage.through))
    stale = (age > 60) | F.lit(coverage.status not in ("CONFIRMED_COMPLETE", "APPARENTLY_CONTINUOUS"))
    rows = rows.withColumn("state_id", state_of(F.col("entity_type"), verified, n, recurring, recent, stale)).withColumn("_s", _named(F.col("state_id")))
    regular = F.col("_s")[1] == "RECURRING_PATTERN"
    return rows.select(
        "request_id", "entity_id", "state_id", F.col("_s")[0].alias("calculated_status"), F.col("_s")[1].alias("recurrence_pattern_status"), F.col("_s")[2].alias("membership_authority"),
        F.when(regular, _mean(F.col("_facts.last_three"), n)).otherwise(F.lit(0)).cast("decimal(12,2)").alias("recurring_amount"),
        F.when(regular, "Monthly").otherwise("None").alias("payment_interval"), "rule_version_id", "evaluation_date", n.cast("long").alias("positive_count"),
    )


def audit_states(assessments: DataFrame, entities: DataFrame, payments: DataFrame, rules: DataFrame, current: int, coverage: Coverage, as_of: bool = False) -> DataFrame:
    """A row for every current assessment: its matrix state, and what recomputing it changes.

    Repair takes the rule `current` and the day the coverage reaches; history takes the stored rule and day (where they
    are null, those of repair). With as_of history counts no payments after its day; without, all, as the audit does.
    Coverage and the disposition of amendments at that day are not known, so that a difference from history is a
    best-effort one, or has no evidence if neither rule nor day was stored.
    """
    known = rules.select("rule_version_id", F.col("rule_version_id").alias("_known"))  # a rule that is not there any more is none
    own = assessments.where("is_current").join(entities.select("entity_id", "entity_type", "verification_status"), "entity_id").join(known, "rule_version_id", "left")
    repair = own.select(
        F.struct("assessment_id", F.lit(False).alias("history")).alias("request_id"), "entity_id", "entity_type", "verification_status",
        F.lit(current).cast("long").alias("rule_version_id"), F.lit(coverage.through).alias("evaluation_date"), F.lit(None).cast("date").alias("upto"),
    )
    day = F.coalesce("calculation_date", F.lit(coverage.through))
    history = own.select(
        F.struct("assessment_id", F.lit(True).alias("history")).alias("request_id"), "entity_id", "entity_type", "verification_status",
        F.coalesce("_known", F.lit(current)).cast("long").alias("rule_version_id"), day.alias("evaluation_date"), (day if as_of else F.lit(None).cast("date")).alias("upto"),
    )
    found = states_at(repair.unionByName(history), payments, rules, coverage)
    fields = [c for c in found.columns if c not in ("request_id", "entity_id")]
    pair = found.groupBy(F.col("request_id.assessment_id").alias("assessment_id")).agg(
        F.max(F.when(~F.col("request_id.history"), F.struct(*fields))).alias("r"), F.max(F.when(F.col("request_id.history"), F.struct(*fields))).alias("h")
    )
    positives = payments.where("transaction_type = 'CONTRIBUTION' and amount > 0").groupBy("entity_id").agg(F.count("*").alias("positive_count"))
    rows = own.alias("s").join(pair, "assessment_id").join(positives, "entity_id", "left")
    before = matrix_state(F.col("entity_type"), F.col("verification_status"), F.col("s.calculated_status"), F.col("s.recurrence_pattern_status"), F.col("s.membership_authority"))
    diffs = {side: F.array_compact(F.array(*[F.when(~_plain("s", f).eqNullSafe(_plain(side, f)), F.lit(f)) for f in DIFF_FIELDS])) for side in ("r", "h")}
    rows = rows.withColumns({"stored_matrix": before, "repair_diffs": diffs["r"], "history_diffs": diffs["h"]})
    evidence = ~count_violation(F.col("stored_matrix"), F.coalesce("positive_count", F.lit(0)))
    unknown = F.col("s.rule_version_id").isNull() & F.col("s.calculation_date").isNull()
    return rows.select(
        "assessment_id", "entity_id", "entity_type", "stored_matrix", F.col("r.state_id").alias("repair_matrix"), (F.col("stored_matrix") != "UNMATCHED").alias("tuple_match"),
        evidence.alias("evidence_match"), "repair_diffs", "history_diffs",
        F.when(F.size("history_diffs") == 0, "HISTORICAL_MATCH").when(unknown, "INSUFFICIENT_HISTORICAL_EVIDENCE").otherwise("BEST_EFFORT_RECONSTRUCTION_MISMATCH").alias("classification"),
        F.col("s.calculated_status").alias("before_status"), F.col("r.calculated_status").alias("after_status"),
        F.col("s.recurrence_pattern_status").alias("before_pattern"), F.col("r.recurrence_pattern_status").alias("after_pattern"),
        F.col("s.membership_authority").alias("before_authority"), F.col("r.membership_authority").alias("after_authority"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """(counter, n): the counters of an audit, in one pass."""
    count = lambda c: F.count_if(c)
    fields = {f"field:{f}": count(F.array_contains("repair_diffs", f)) for f in DIFF_FIELDS}
    kinds = {f"history:{k}": count(F.col("classification") == k) for k in ("HISTORICAL_MATCH", "BEST_EFFORT_RECONSTRUCTION_MISMATCH", "INSUFFICIENT_HISTORICAL_EVIDENCE")}
    counters = {
        "total_assessments": F.count("*"), "matrix_tuple_violations": count(~F.col("tuple_match")), "evidence_context_violations": count(~F.col("evidence_match")),
        "historical_parity_mismatches": count(F.size("history_diffs") > 0), "current_repair_mismatches": count(F.size("repair_diffs") > 0),
        "fully_matching": count((F.size("repair_diffs") == 0) & F.col("tuple_match") & F.col("evidence_match")), **fields, **kinds,
    }
    one = audit.agg(F.array(*[F.struct(F.lit(k).alias("counter"), v.alias("n")) for k, v in counters.items()]).alias("_x"))
    return one.select(F.inline("_x"))


def repair_manifest(diff: DataFrame) -> DataFrame:
    """How many entities change from one status to another."""
    return diff.where(F.size("changed_fields") > 0).groupBy(F.concat_ws("->", "before", "after").alias("transition")).agg(F.count("*").alias("n"))


def repair_summary(audit: DataFrame) -> DataFrame:
    """(section, item, n): all sections of the manifest of audit_states() from one scan and one shuffle.

    Each row says what it adds to: its type, unchanged or to be replaced, the transitions of status, pattern, authority
    and matrix state, and the other fields that change.
    """
    changed = F.size("repair_diffs") > 0
    has = lambda f: F.array_contains("repair_diffs", f)
    item = lambda section, name, when: F.when(when, F.struct(F.lit(section).alias("section"), name.alias("item")))
    moves = [("calculated_status", "status"), ("recurrence_pattern_status", "pattern"), ("membership_authority", "authority")]
    items = [
        item("examined", F.lit("total"), F.lit(True)),
        item("entity_type", F.col("entity_type"), F.lit(True)),
        item("rows", F.when(changed, "replaced").otherwise("unchanged"), F.lit(True)),
        *[item(f, F.concat_ws("->", F.coalesce(f"before_{s}", F.lit("None")), f"after_{s}"), has(f)) for f, s in moves],
        *[item("changed", F.lit(f), has(f)) for f in DIFF_FIELDS[3:]],
        item("matrix_state", F.concat_ws("->", "stored_matrix", "repair_matrix"), changed),
    ]
    return audit.select(F.explode(F.array_compact(F.array(*items))).alias("x")).groupBy("x.section", "x.item").agg(F.count("*").alias("n"))


def audit_repair_parity(audit: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entities for which audit and manifest (entity_id, changed_fields, before, after) differ."""
    a, m = audit.alias("a"), manifest.alias("m")
    same = F.col("a.before").eqNullSafe(F.col("m.before")) & F.col("a.after").eqNullSafe(F.col("m.after")) & F.array_sort("a.changed_fields").eqNullSafe(F.array_sort("m.changed_fields"))
    issue = F.when(F.col("m.entity_id").isNull(), "ONLY_IN_AUDIT").when(F.col("a.entity_id").isNull(), "ONLY_IN_MANIFEST").when(~same, "DIFFERENT")
    return a.join(m, F.col("a.entity_id") == F.col("m.entity_id"), "full_outer").select(F.coalesce("a.entity_id", "m.entity_id").alias("entity_id"), issue.alias("issue")).where("issue is not null")


def repair_records(audit: DataFrame) -> DataFrame:
    """A row for every assessment of audit_states() that repair replaces."""
    changed = audit.where(F.size("repair_diffs") > 0)
    return changed.select(
        "entity_id", F.col("assessment_id").alias("current_assessment_id"), "entity_type", "before_status", "after_status", "before_pattern", "after_pattern", "before_authority", "after_authority",
        F.col("stored_matrix").alias("matrix_state_before"), F.col("repair_matrix").alias("matrix_state_after"), F.lit("STATE_MISMATCH").alias("reason_code"),
        F.array_contains("repair_diffs", "calculated_status").alias("chapter_reevaluation_needed"), F.col("repair_diffs").alias("changed_fields"),
    )
