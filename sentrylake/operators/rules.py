"""Rules as boolean columns, and what several hits on one event make."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import compare, equals, not_in, one_of, regex, rule_matches


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    score: float
    severity: str
    where: dict[str, Callable[[Column], Column]]
    tags: Sequence[str] = field(default=())


#: The built-in rule pack in catalogue order.
RULES = (
    Rule("T1059.LIVING_OFF_THE_LAND", "Living-off-the-land binary execution", 0.7, "medium",
         {"event_type": equals("process"), "command_line": regex(r"\b(curl|wget|bash\s+-i|nc\s+-e|powershell|certutil|mshta)\b")}, ("mitre:T1059", "execution")),
    Rule("T1027.ENCODED_PAYLOAD", "Encoded payload in command line", 0.85, "high",
         {"command_line": regex(r"(?:base64|-enc(?:oded)?)\s+[A-Za-z0-9+/=]{40,}")}, ("mitre:T1027", "defense-evasion")),
    Rule("T1055.SUSPICIOUS_PARENT", "Shell spawned from Office/Browser parent", 0.9, "high",
         {"event_type": equals("process"), "process": one_of("cmd.exe", "bash", "sh", "powershell.exe", "pwsh"), "command_line": regex(r".+")}, ("mitre:T1055",)),
    Rule("T1078.ROOT_LOGIN_FAILED", "Failed root/admin login", 0.65, "medium",
         {"message": regex(r"failed (login|password) for (root|admin)")}, ("mitre:T1078", "credential-access")),
    Rule("T1003.SENSITIVE_FILE_READ", "Sensitive credential file accessed", 0.9, "high",
         {"event_type": equals("file"), "file_path": regex(r"(/etc/(shadow|passwd)|\\sam\\|sysprep)")}, ("mitre:T1003",)),
    Rule("T1071.EXTERNAL_BEACON", "Outbound connection on rare port", 0.6, "medium",
         {"event_type": equals("network"), "dst_port": not_in(80, 443, 53, 22, 3389)}, ("mitre:T1071",)),
    Rule("T1547.STARTUP_WRITE", "Write to autorun/startup location", 0.8, "high",
         {"event_type": equals("file"), "action": one_of("write", "create"), "file_path": regex(r"(Startup|Run\\|/etc/cron|/etc/init|systemd/system)")}, ("mitre:T1547", "persistence")),
    Rule("T1486.RANSOMWARE_EXT", "Ransomware-style file extension write", 0.95, "critical",
         {"event_type": equals("file"), "file_path": regex(r"\.(locked|encrypted|crypted|crypt|wnry|cerber)$")}, ("mitre:T1486", "impact")),
    Rule("HEURISTIC.LARGE_EGRESS", "Large outbound transfer", 0.55, "medium",
         {"event_type": equals("network"), "bytes_sent": compare(">", 50_000_000)}, ("exfiltration",)),
    Rule("HEURISTIC.TMP_EXEC", "Execution from temp/world-writable directory", 0.7, "medium",
         {"event_type": equals("process"), "command_line": regex(r"(/tmp/|\\AppData\\|\\Temp\\|/dev/shm/)")}, ("execution",)),
)


def rule_hits(rules: Sequence[Rule] = RULES) -> Column:
    """Array of structs (rule_id, name, score, severity, tags) of the rules that match a row, in catalogue order."""
    hits = [
        F.when(
            rule_matches(r.where),
            F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.score).alias("score"), F.lit(r.severity).alias("severity"),
                F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"),
            ),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*hits))


def combine_rule_hits(events: DataFrame, hits: Column) -> DataFrame:
    """One detection for each event with a hit, without a shuffle.

    The score is the best hit's plus 0.05 for each further one, at most 1; the
    severity that of the best, the first in the catalogue among equals.
    Columns of the events with the names of a detection's are replaced.
    """

    def better(best: Column, h: Column) -> Column:
        return F.when(best["score"] >= h["score"], best).otherwise(h)

    h = F.col("hits")
    found = events.withColumn("hits", hits).where(F.size("hits") > 0)
    best = F.aggregate(h, h[0], better)
    score = F.least(F.lit(1.0), best["score"] + 0.05 * (F.size(h) - 1))
    reasons = F.transform(h, lambda x: F.concat_ws(": ", x["rule_id"], x["name"]))
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform(h, lambda x: x["tags"]))))
    new = {"detector": F.lit("rule"), "score": score, "severity": best["severity"], "reasons": reasons, "tags": tags, "rule_count": F.size(h)}
    return found.select(*(c for c in events.columns if c not in (*new, "hits")), *(c.alias(name) for name, c in new.items()))


def rule_detections(events: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return combine_rule_hits(events, rule_hits(rules))
