"""What a message asks for: its page, where it leads, whether it wants help, and whether it is about safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a complaint that make it critical whatever else is said.
SAFETY = [
    "toxic fume", "no safety gear", "no ppe", "without ppe", "no mask", "no harness",
    "assault", "assaulted", "molest", "sexual harassment", "life threat", "threatened to kill",
    "police complaint", "manual scavenging", "sewage tank", "drowned", "electrocut",
]

#: Words of a message and the page they lead to; the first that has one wins.
ROUTES = [
    ("/tasks", ["task", "assignment", "workload", "reassign", "sow", "milestone"]),
    ("/grievances", ["grievance", "complaint"]),
    ("/calendar", ["calendar", "event", "training schedule", "holiday", "upcoming"]),
    ("/legal", ["compliance", "statutory", " pf ", "pf number", "esic", "gratuity", "tds", "cghs", "legal"]),
    ("/leave", ["leave", "leave request", "leave balance", "leave approval"]),
    ("/org360", ["org chart", "hierarchy", "reporting structure", "org 360"]),
    ("/finance", ["payroll", "budget", "finance", "disbursement", "arrears"]),
    ("/performance", ["performance", "appraisal", "rating"]),
    ("/ocr-scanner", ["ocr", "scan", "digitiz"]),
    ("/documents", ["document", "service book"]),
    ("/employees", ["employee directory", "employee profile", "search employee", "find employee"]),
]

#: What a request for help says, and its topics: a topic needs one word of each of its groups.
HELP = ["how do i", "how to", "how can i", "where do i", "where can i", "can i", "help me", "steps to", "guide me"]
TOPICS = [
    ("delete a task", [["delete", "remove"], ["task"]]),
    ("hand over a task", [["reassign", "reallocate", "hand off", "transfer"], ["task"]]),
    ("dismiss an alert", [["dismiss", "remove", "clear", "delete", "hide"], ["alert"]]),
    ("add an event", [["add", "create"], ["event", "reminder"]]),
    ("delete an event", [["delete", "remove"], ["event", "reminder"]]),
    ("apply for leave", [["apply", "request", "take"], ["leave"]]),
    ("decide on leave", [["approve", "reject", "review", "decide"], ["leave"]]),
    ("file a grievance", [["file", "raise", "submit", "complain", "report"], ["grievance", "complaint"]]),
    ("download a record", [["download", "generate", "get", "see"], ["service record", "my report", "payslip"]]),
    ("search an employee", [["search", "find", "look up"], ["employee"]]),
    ("scan a document", [["scan", "digitize", "upload", "ocr"], ["document", "service book"]]),
    ("read a health score", [["health score", "org 360", "department drill", "department profile", "department card"]]),
]


def says_any(message: Column, words: list[str]) -> Column:
    """Whether one of the words is part of the lower-case message."""
    said = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | said.contains(word)
    return found


def without_context(message: Column) -> Column:
    """The message without the page context in square brackets before it."""
    return F.regexp_replace(message, r"^\[Context:[^\n]*?\]\s*", "")


def page_name(message: Column) -> Column:
    """The page that the context before a message names, or null."""
    return F.nullif(F.trim(F.regexp_extract(message, r"^\[Context:\s*([^·\]]+?)\s*(?:·|$)", 1)), F.lit(""))


def safety_severity(message: Column) -> Column:
    return F.when(says_any(message, SAFETY), "Critical").otherwise("Normal")


def route(message: Column) -> Column:
    """The page that the first matching rule leads to, or null; page context doesn't count."""
    said, out = without_context(message), None
    for path, words in ROUTES:
        out = F.when(says_any(said, words), path) if out is None else out.when(says_any(said, words), path)
    return out


def help_topic(message: Column) -> Column:
    """The first topic of which every group is met, if the message asks for help at all; else null."""
    said, out = without_context(message), None
    for topic, groups in TOPICS:
        met = F.lit(True)
        for words in groups:
            met = met & says_any(said, words)
        out = F.when(met, topic) if out is None else out.when(met, topic)
    return F.when(says_any(said, HELP), out)


def asked_count(message: Column, default: int = 5, most: int = 50) -> Column:
    """The number that a message asks for after top, bottom, first or last, within 1 and ``most``."""
    n = F.regexp_extract(F.lower(without_context(message)), r"\b(?:top|bottom|first|last)\s+([0-9]{1,4})\b", 1)
    return F.when(n == "", default).otherwise(F.least(F.greatest(n.try_cast("int"), F.lit(1)), F.lit(most)))


def named_entity(message: Column, names: list[str]) -> Column:
    """The longest of ``names``, a short list, that the message has as a part; ties go by name."""
    said, out = F.lower(without_context(message)), F.lit(None).cast("string")
    for name in sorted(names, key=lambda n: (len(n), [-ord(c) for c in n])):
        out = F.when(said.contains(name.lower()), F.lit(name)).otherwise(out)
    return out
