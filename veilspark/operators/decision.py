"""Policies, suggestions and reviewers' decisions.

A policy maps (type, confidence, value) to redact, ask or keep and never changes what was detected.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDACT, ASK, KEEP = "redact", "ask", "keep"


@dataclass(frozen=True)
class Policy:
    """default_action: for types that ``types`` doesn't list; types: {type: {"action": ..., "allow_values": [...]}}."""

    name: str
    description: str = ""
    default_action: str = REDACT
    auto_redact_above: float = 0.9
    ask_above: float = 0.5
    types: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.ask_above <= self.auto_redact_above <= 1:
            raise ValueError("a policy needs 0 <= ask_above <= auto_redact_above <= 1")
        for a in (self.default_action, *(t.get("action", REDACT) for t in self.types.values())):
            if a not in (REDACT, ASK, KEEP):
                raise ValueError(f"unknown action {a!r}")

    def action(self, kind: str) -> str:
        return self.types.get(kind, {}).get("action", self.default_action)


PRESETS = {
    p.name: p
    for p in (
        Policy("share-with-ai", "Before a document goes to an assistant: every value found is redacted."),
        Policy("kyc", "For an identity check: tax and national numbers stay, the rest is redacted.", types={"PAN": {"action": KEEP}, "AADHAAR": {"action": KEEP}}),
        Policy("minimal", "Nothing by itself: every value is put to the reviewer.", default_action=ASK),
    )
}
DEFAULT = "share-with-ai"


def list_policies() -> list[str]:
    """Names of the presets, in order."""
    return sorted(PRESETS)


def get_policy(name_or_path: str = DEFAULT) -> Policy:
    """A preset, or a policy file (JSON or YAML)."""
    if name_or_path in PRESETS:
        return PRESETS[name_or_path]
    path = Path(name_or_path)
    if path.suffix.lower() not in (".json", ".yaml", ".yml") or not path.is_file():
        raise ValueError(f"no policy {name_or_path!r}; there are {', '.join(sorted(PRESETS))}, or a .json, .yaml or .yml file")
    if path.suffix.lower() == ".json":
        return Policy(**json.loads(path.read_text()))
    import yaml

    return Policy(**yaml.safe_load(path.read_text()))


def suggest(detections: DataFrame, policy: Policy) -> DataFrame:
    """Review entries: the detections with suggested_action, suggestion_reason and an empty decision, in order
    (entry_ord: page, start, type, then as detected)."""
    kind, conf = F.col("detection_type"), F.col("confidence")
    action = F.lit(policy.default_action)
    allowed: Column = F.lit(False)
    for t, p in policy.types.items():
        action = F.when(kind == t, F.lit(p.get("action", REDACT))).otherwise(action)
        if p.get("allow_values"):
            allowed = allowed | ((kind == t) & F.col("text").isin(list(p["allow_values"])))
    two = lambda x: F.format_string("%.2f", x)
    high, low = F.lit(float(policy.auto_redact_above)), F.lit(float(policy.ask_above))
    # each row: condition, action, reason; the first that holds counts
    rules = [
        (allowed, KEEP, F.lit("value is allow-listed by the policy")),
        (action == KEEP, KEEP, F.concat(F.lit(f"policy '{policy.name}' keeps "), kind)),
        (action == ASK, ASK, F.concat(F.lit(f"policy '{policy.name}' defers "), kind, F.lit(" to review"))),
        (conf >= high, REDACT, F.concat(F.lit("confidence "), two(conf), F.lit(" >= auto-redact threshold "), two(high))),
        (conf >= low, ASK, F.concat(F.lit("confidence "), two(conf), F.lit(" in the ask band ["), two(low), F.lit(", "), two(high), F.lit(")"))),
        (F.lit(True), KEEP, F.concat(F.lit("confidence "), two(conf), F.lit(" below the ask threshold "), two(low), F.lit(" (probable noise)"))),
    ]
    pick = lambda k: F.coalesce(*(F.when(r[0], r[k] if isinstance(r[k], Column) else F.lit(r[k])) for r in rules))
    order = Window.partitionBy("doc_id").orderBy("page_number", "start", "detection_type", "block_ord", "detector_ord", "pattern_ord")
    return detections.withColumns({"suggested_action": pick(1), "suggestion_reason": pick(2), "decision": F.lit(None).cast("string"), "entry_ord": F.row_number().over(order) - 1})


def effective(entries: DataFrame) -> Column:
    return F.coalesce(entries["decision"], entries["suggested_action"])


def counts(entries: DataFrame) -> DataFrame:
    """n_redact, n_ask, n_keep of each document, by effective action; zeros included."""
    n = lambda a: F.sum((F.coalesce("decision", "suggested_action") == a).cast("bigint")).alias(f"n_{a}")
    return entries.groupBy("doc_id").agg(n(REDACT), n(ASK), n(KEEP))


def pending(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("suggested_action") == ASK) & F.col("decision").isNull())


def decide(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries with the decisions (doc_id, detection_id, decision, decided_ord) of a reviewer put in. Of several for one id the
    one of the highest decided_ord counts; a null decision clears the entry's."""
    last = decisions.groupBy("doc_id", "detection_id").agg(F.max_by(F.struct("decision"), "decided_ord").alias("new_"))
    value = F.when(F.col("new_").isNull(), F.col("decision")).otherwise(F.col("new_.decision"))
    return entries.join(last, ["doc_id", "detection_id"], "left").withColumn("decision", value).drop("new_").select(*entries.columns)


def decide_all(entries: DataFrame, condition: Column, decision: str) -> DataFrame:
    """The same decision for all entries that meet the condition."""
    return entries.withColumn("decision", F.when(condition, F.lit(decision)).otherwise(F.col("decision")))


def restore(entries: DataFrame, saved: DataFrame) -> DataFrame:
    """Entries with the decisions of a saved plan of the same source (equal source_sha256), and its manual entries. Of several
    saved entries of one id the first decision counts."""
    same = saved.join(entries.select("doc_id", "source_sha256").distinct(), ["doc_id", "source_sha256"], "left_semi")
    old = same.filter(F.col("decision").isNotNull()).groupBy("doc_id", "detection_id").agg(F.min_by("decision", "entry_ord").alias("old_"))
    out = entries.join(old, ["doc_id", "detection_id"], "left").withColumn("decision", F.coalesce("decision", "old_")).drop("old_")
    manual = same.filter(F.col("detector_name") == "manual").join(entries.select("doc_id", "detection_id"), ["doc_id", "detection_id"], "left_anti")
    return out.select(*entries.columns).unionByName(manual.select(*entries.columns))


def resolve(entries: DataFrame, accept_suggestions: bool = False) -> DataFrame:
    """What to redact. Without ``accept_suggestions`` every entry needs a decision; with it, undecided redact and ask
    suggestions are redacted."""
    if not accept_suggestions and (n := entries.filter(F.col("decision").isNull()).count()):
        raise ValueError(f"{n} entries have no decision")
    return entries.filter(F.when(F.col("decision").isNotNull(), F.col("decision") == REDACT).otherwise(F.col("suggested_action").isin(REDACT, ASK)))
