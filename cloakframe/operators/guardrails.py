"""Risk scores for conversations: per message, per conversation, and against domain thresholds.

The scoring model of the reference is a remote service; here a processor is a rule (a pattern with a
score).  Everything is Catalyst expressions, one aggregate and one lookup join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------
ROLES = ("user", "ai", "context")
OUTCOMES = ("approved", "rejected", "skipped")
MAX_CONTENT = 10_024
# ------------------------------------------------------------------------------------------------------

SENDER_OF = {"user": "user", "assistant": "ai", "system": "context"}
RECIPIENT_OF = {"user": "ai", "ai": "user", "context": "ai"}
REJECT_FROM = 0.5


@dataclass(frozen=True)
class MessageRule:
    name: str
    pattern: str
    score: float
    explanation: str = ""

    def __post_init__(self):
        if not 0 <= self.score <= 1:
            raise ValueError(f"{self.name}: score must lie in 0..1, got {self.score}")


MESSAGE_RULES = (
    MessageRule("instruction-override", r"(?i)ignore (?:all |any )?(?:previous|prior) instructions", 0.95, "asks to drop instructions"),
    MessageRule("prompt-disclosure", r"(?i)(?:reveal|print|show) (?:me )?(?:your |the )?system prompt", 0.9, "asks for hidden instructions"),
    MessageRule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.7, "holds an e-mail address"),
    MessageRule("long-number", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.8, "holds a card-like number"),
)


def _mapped(column: Column, mapping: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), column)


def as_messages(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, id, from, to, content, problem): roles mapped to sender and recipient, and what a
    strict scanner would object to (unknown role, no content, content beyond the limit)."""
    sender = _mapped(F.col(role), SENDER_OF)
    recipient = _mapped(sender, RECIPIENT_OF)
    problem = (
        F.when(sender.isNull() | ~sender.isin(*ROLES), F.lit("unknown role"))
        .when(F.col(text).isNull(), F.lit("no content"))
        .when(F.length(text) > MAX_CONTENT, F.lit("content too long"))
    )
    return df.select(
        F.col(conversation).alias("conversation"),
        F.concat_ws("-", conversation, turn).alias("id"),
        sender.alias("from"), recipient.alias("to"), F.col(text).alias("content"), problem.alias("problem"),
    )


def scan_messages(
    messages: DataFrame, rules: tuple[MessageRule, ...] = MESSAGE_RULES, scanned: Column | None = None,
    threshold: Column | float = REJECT_FROM,
) -> DataFrame:
    """Add (outcome, score, processors).  A message not ``scanned`` (no processor asked for) is skipped and
    has no score; otherwise the score is the highest of the rules that match, 0 if none does, and the
    message is rejected from ``threshold`` on.  Content is always read whole."""
    scanned = F.lit(True) if scanned is None else F.coalesce(scanned, F.lit(False))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hits = F.array(
        *[
            F.when(
                F.col("content").rlike(r.pattern),
                F.struct(F.lit(r.name).alias("name"), F.lit(r.score).alias("score"), F.lit(r.explanation).alias("explanation")),
            )
            for r in rules
        ]
    )
    score = F.coalesce(F.array_max(F.transform("processors", lambda p: p["score"])), F.lit(0.0))
    return (
        messages.withColumn("processors", F.when(scanned, F.array_compact(hits)).otherwise(F.array_compact(F.slice(hits, 1, 0))))
        .withColumn("score", F.when(scanned, score))
        .withColumn(
            "outcome",
            F.when(~scanned, "skipped").when(F.col("score") >= limit, "rejected").otherwise("approved"),
        )
    )


def batch_risk(scanned: DataFrame) -> DataFrame:
    """Per conversation: rejected if any message is, the highest score, and how many were rejected.  The
    rejected ids are rows of :func:`rejected_messages`, not an array that grows with the conversation."""
    rejected = F.col("outcome") == "rejected"
    return scanned.groupBy("conversation").agg(
        F.when(F.bool_or(rejected), "rejected").otherwise("approved").alias("outcome"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.count_if(rejected).alias("rejected_count"),
        F.count("*").alias("messages"),
    )


def rejected_messages(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("outcome") == "rejected").select("conversation", "id", "score")


def with_domain_threshold(messages: DataFrame, models: DataFrame, domain: str = "domain") -> DataFrame:
    """Attach (model_name, threshold) of each message's domain; an unknown domain has neither."""
    return messages.join(models.select(domain, "model_name", "threshold"), domain, "left")
