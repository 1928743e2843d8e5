"""Messages of conversations with what users ask put before them: routes, topics, contexts, safety words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions import messages

#: What stands before a conversation's texts, by its number.
_SAID = [
    "[Context: Tasks · Department: Water Supply] How do I reassign a TASK? ",
    "[Context: Legal] Show the top 12 compliance deadlines. ",
    "We worked with no harness all week. ",
    "How can I apply for leave next month? ",
    "He was nearly Electrocuted at the pump. ",
    "Masks and gear were given to all. ",
    "Find employee in Fire and Water Supply, first 500. ",
    "",
]
_SQL_SAID = "CASE conv_id % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAID)) + " END || text"
_ORGS = ["Fire", "Water Supply", "Water"]


def _message(t):
    k, said = F.col("conv_id") % 8, F.lit(_SAID[7])
    for i, x in enumerate(_SAID[:7]):
        said = F.when(k == i, x).otherwise(said)
    return t.conversations.select("conv_id", "turn", F.concat(said, F.col("text")).alias("message"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"strpos(said, '{w}') > 0" for w in words) + ")"


_BODY = f"WITH m AS (SELECT conv_id, turn, {_SQL_SAID} AS message FROM conversations), b AS (SELECT *, CASE WHEN starts_with(message, '[Context:') THEN ltrim(substr(message, strpos(message, ']') + 1)) ELSE message END AS body FROM m), s AS (SELECT *, lower(body) AS said FROM b)"


@query("n22_hard_triggers", f"WITH s AS (SELECT conv_id, turn, lower({_SQL_SAID}) AS said FROM conversations) SELECT conv_id, turn, CASE WHEN {_any(messages.SAFETY)} THEN 'Critical' ELSE 'Normal' END AS severity FROM s")
def _(t):
    return _message(t).select("conv_id", "turn", messages.safety_severity(F.col("message")).alias("severity"))


@query(
    "n20_routed_messages",
    _BODY
    + " SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN {_any(words)} THEN '{path}'" for path, words in messages.ROUTES)
    + " END AS route, CASE WHEN "
    + _any(messages.HELP)
    + " THEN CASE "
    + " ".join(f"WHEN {' AND '.join(map(_any, groups))} THEN '{topic}'" for topic, groups in messages.TOPICS)
    + " END END AS topic, CASE WHEN strpos(said, 'water supply') > 0 THEN 'Water Supply' WHEN strpos(said, 'water') > 0 THEN 'Water' WHEN strpos(said, 'fire') > 0 THEN 'Fire' END AS org, least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(said, '\\b(top|bottom|first|last)\\s+([0-9]{1,4})\\b', 2), '') AS INTEGER), 5), 1), 50) AS asked FROM s",
)
def _(t):
    m = F.col("message")
    return _message(t).select("conv_id", "turn", messages.route(m).alias("route"), messages.help_topic(m).alias("topic"), messages.named_entity(m, _ORGS).alias("org"), messages.asked_count(m).alias("asked"))


@query("n23_page_contexts", _BODY + " SELECT conv_id, turn, CASE conv_id % 8 WHEN 0 THEN 'Tasks' END AS page, sha256(body) AS body_sha256 FROM s")
def _(t):
    m = F.col("message")
    return _message(t).select("conv_id", "turn", messages.page_name(m).alias("page"), F.sha2(messages.without_context(m), 256).alias("body_sha256"))
