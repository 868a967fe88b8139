"""Log lines to event columns: format detection, four parsers, normalisation, timestamps and indicators.

Everything is an expression over the line; bad input gives null fields, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line formats.
SYSLOG = r"^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
AUDITD = r"^type=([A-Z_]+)\s+msg=audit\(([\d.]+):(\d+)\):(.*)$"
CEF = r"^CEF:(\d+)\|(.*)$"
KV = r'([A-Za-z_][\w\.\-]*)=(?:"([^"]*)"|(\S+))'

#: Other names of each field, in the order in which they are tried; a dotted name is a path too.
ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "ts", "time", "eventTime", "EventTime"),
    "host": ("host", "hostname", "host.name", "computer", "HostName"),
    "user": ("user", "user.name", "username", "TargetUserName"),
    "process": ("process", "process.name", "image", "Image", "comm"),
    "pid": ("pid", "process.pid", "ProcessId"),
    "parent_pid": ("parent_pid", "process.parent.pid", "ParentProcessId", "ppid"),
    "command_line": ("command_line", "process.command_line", "CommandLine", "cmd", "cmdline"),
    "src_ip": ("src_ip", "source.ip", "src", "SourceIp"),
    "dst_ip": ("dst_ip", "destination.ip", "dst", "DestinationIp"),
    "src_port": ("src_port", "source.port", "SourcePort"),
    "dst_port": ("dst_port", "destination.port", "DestinationPort"),
    "protocol": ("protocol", "network.protocol", "proto", "Protocol"),
    "file_path": ("file_path", "file.path", "path", "TargetFilename"),
    "action": ("action", "event.action", "EventName"),
    "status": ("status", "event.outcome", "result"),
    "bytes_sent": ("bytes_sent", "source.bytes", "bytes_out"),
    "bytes_recv": ("bytes_recv", "destination.bytes", "bytes_in"),
    "message": ("message", "msg"),
    "severity": ("severity", "event.severity", "level"),
}
INTS = ("pid", "parent_pid", "src_port", "dst_port", "bytes_sent", "bytes_recv")
TYPES = ("process", "network", "file", "auth", "syscall", "audit", "unknown")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def detect_format(line: Column) -> Column:
    """Json, cef, auditd, syslog or unknown."""
    s = F.regexp_replace(line, r"^\s+", "")
    json = s.startswith("{") & F.regexp_replace(s, r"\s+$", "").endswith("}")
    known = F.when(json, "json").when(s.startswith("CEF:"), "cef").when(s.startswith("type=") & s.contains("msg=audit("), "auditd").when(s.rlike(SYSLOG), "syslog")
    return F.coalesce(known, F.lit("unknown"))


def extract_kv(text: Column) -> Column:
    """Map of ``k=v`` and ``k="v"``; of a repeated key the last."""
    keys, quoted, plain = (F.regexp_extract_all(text, F.lit(KV), F.lit(i)) for i in (1, 2, 3))
    both = F.zip_with(quoted, plain, lambda q, p: F.when(p != "", p).otherwise(q))

    def last(k: Column) -> Column:
        # a place counts if its key does not come again
        places = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: F.array_position(F.slice(k, i + 2, F.size(k)), F.get(k, i)) == 0)
        return F.when(F.size(k) == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(F.transform(places, lambda i: F.get(k, i)), F.transform(places, lambda i: F.get(both, i))))

    return F.transform(F.array(keys), last)[0]


def parse_timestamp(value: Column, year: int | None = None) -> Column:
    """P10: epoch seconds from numbers (by size s, ms, us or ns), ISO text and syslog dates (of ``year``, else this one); null if it is none."""
    s = F.trim(value.cast("string"))
    # text that is no number costs an exception, so it is tried once
    number = _once(s.try_cast("double"), lambda v: F.when(v > 1e17, v / 1e9).when(v > 1e14, v / 1e6).when(v > 1e11, v / 1e3).otherwise(v))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})T", "$1 "))) / F.lit(1e6))
    of_year = F.lit(str(year)) if year else F.year(F.current_timestamp()).cast("string")
    dated = F.concat_ws(" ", of_year, F.regexp_replace(s, r"\s+", " "))
    syslog = F.when(s.rlike(r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), F.unix_micros(F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss"))) / F.lit(1e6))
    return F.coalesce(number, iso, syslog)


def format_iso(ts: Column) -> Column:
    """UTC with milliseconds and Z (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_micros(F.round(ts * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Objects in which aliases with dots lie.
_INNER = tuple(sorted({n.rpartition(".")[0] for names in ALIASES.values() for n in names if "." in n} | {"event"}))


def _json_maps(doc: Column) -> Column:
    """A parsed object as maps of its fields' texts: its own, and those of the objects in it that aliases name."""
    of = lambda path: F.try_variant_get(doc, path, "map<string,string>")
    return F.struct(of("$").alias("top"), *(of(f"$.{p}").alias(f"in_{i}") for i, p in enumerate(_INNER)))


def _json_field(maps: Column, names: tuple[str, ...]) -> Column:
    """The first name that has a value which is neither object nor array."""
    found = []
    for name in names:
        inner, _, last = name.rpartition(".")
        places = [(maps["top"], name)] + ([(maps[f"in_{_INNER.index(inner)}"], last)] if inner else [])
        found += [_once(F.try_element_at(m, F.lit(key)), _scalar) for m, key in places]
    return F.coalesce(*found)


def _scalar(value: Column) -> Column:
    return F.when(~F.substring(value, 1, 1).isin("{", "["), value)


def classify(explicit: Column, hint: Column, f: dict[str, Column]) -> Column:
    """An explicit known type, else by hint or by the fields that are there."""
    has = lambda name: F.coalesce(f[name] != "", F.lit(False)) if name in f else F.lit(False)
    h = F.lower(F.coalesce(hint, F.lit("")))
    known = F.when(F.lower(explicit).isin(*TYPES), F.lower(explicit))
    guessed = (
        F.when(h.contains("process") | has("process") | has("command_line"), "process")
        .when(h.contains("network") | has("src_ip") | has("dst_ip"), "network")
        .when(h.contains("file") | has("file_path"), "file")
        .when(h.contains("auth") | F.coalesce(f["action"].isin("login", "logout", "auth"), F.lit(False)), "auth")
        .when(h.contains("audit"), "audit")
        .otherwise("unknown")
    )
    return F.coalesce(known, guessed)


FIELDS = ("timestamp", "event_type", "host", "user", "process", "pid", "parent_pid", "command_line", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "file_path", "action", "status", "bytes_sent", "bytes_recv", "message", "severity", "source")


def _event(**fields: Column) -> Column:
    types = {"timestamp": "double", **{k: "bigint" if k.startswith("bytes") else "int" for k in INTS}}
    return F.struct(*(fields.get(k, F.lit(None)).try_cast(types.get(k, "string")).alias(k) for k in FIELDS))


def parse_json(line: Column, year: int | None = None) -> Column:
    """An event struct from a JSON object; null if the line is none.

    The object is parsed once, its fields are looked up once; what follows uses their values.
    """

    def of(doc: Column) -> Column:
        return F.when(doc.isNotNull(), _once(_json_maps(doc), fields))

    def fields(maps: Column) -> Column:
        top, event = maps["top"], maps[f"in_{_INNER.index('event')}"]
        hints = (_blank_to_null(F.try_element_at(m, F.lit(key))) for m, key in ((event, "category"), (top, "category"), (top, "type")))
        explicit = F.try_element_at(top, F.lit("event_type"))
        return _once(F.struct(*(_json_field(maps, names).alias(k) for k, names in ALIASES.items()), explicit.alias("explicit"), F.coalesce(*hints).alias("hint")), found)

    def found(x: Column) -> Column:
        f = {k: x[k] for k in ALIASES}
        return _event(**(f | {"timestamp": parse_timestamp(f["timestamp"], year), "event_type": classify(x["explicit"], x["hint"], f), "source": F.lit("json")}))

    return _once(F.when(line.rlike(r"^\s*\{"), F.try_parse_json(line)), of)


def parse_syslog(line: Column, year: int | None = None) -> Column:
    """P04."""
    s = F.trim(line)
    g = [None] + [F.regexp_extract(s, SYSLOG, i) for i in range(1, 7)]
    return F.when(
        s.rlike(SYSLOG),
        _event(timestamp=parse_timestamp(g[2], year), host=g[3], process=g[4], pid=_blank_to_null(g[5]), message=g[6], event_type=F.lit("audit"), source=F.lit("syslog")),
    )


def _once(value: Column, of) -> Column:
    """of(value), the value evaluated once: a lambda's variable is."""
    return F.transform(F.array(value), of)[0]


def parse_auditd(line: Column) -> Column:
    """P05."""

    def of(x: Column) -> Column:
        kv, kind = x["kv"], x["kind"]
        get = lambda *names: F.coalesce(*(_blank_to_null(F.try_element_at(kv, F.lit(n))) for n in names))
        digits = lambda n: F.when(get(n).rlike(r"^\d+$"), get(n))
        return _event(
            timestamp=x["ts"], user=get("uid", "auid"), process=get("comm", "exe"), pid=digits("pid"), parent_pid=digits("ppid"), command_line=get("cmd"),
            action=F.coalesce(get("op"), F.lower(kind)), event_type=F.when(kind == "SYSCALL", "syscall").otherwise("audit"), file_path=get("name", "path"), source=F.lit("auditd"),
        )

    s = F.trim(line)
    # the time is a number of seconds
    parts = F.struct(F.regexp_extract(s, AUDITD, 1).alias("kind"), F.regexp_extract(s, AUDITD, 2).try_cast("double").alias("ts"), extract_kv(F.regexp_extract(s, AUDITD, 4)).alias("kv"))
    return F.when(s.rlike(AUDITD), _once(parts, of))


def parse_cef(line: Column) -> Column:
    """P06."""

    def of(x: Column) -> Column:
        parts, kv = x["parts"], x["kv"]
        get = lambda *names: F.coalesce(*(_blank_to_null(F.try_element_at(kv, F.lit(n))) for n in names))
        digits = lambda n: F.when(get(n).rlike(r"^\d+$"), get(n))
        name = F.get(parts, F.lit(4))
        event = _event(
            timestamp=_once(get("rt", "start"), lambda t: parse_timestamp(t)), host=get("dvchost"), src_ip=get("src"), dst_ip=get("dst"), src_port=digits("spt"), dst_port=digits("dpt"), user=get("suser", "duser"),
            action=name, severity=F.get(parts, F.lit(5)), message=name, event_type=F.when(get("src").isNotNull() | get("dst").isNotNull(), "network").otherwise("audit"),
            source=F.concat_ws(":", F.lit("cef"), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))),
        )
        return F.when(F.size(parts) >= 6, event)

    s = F.trim(line)
    split = F.split(F.regexp_extract(s, CEF, 2), r"\|")
    with_kv = lambda p: F.struct(p.alias("parts"), extract_kv(F.coalesce(F.get(p, F.lit(6)), F.lit(""))).alias("kv"))
    return F.when(s.rlike(CEF), _once(_once(split, with_kv), of))


def parse_lines(lines: DataFrame, col: str = "line", fmt: str | None = None, year: int | None = None) -> DataFrame:
    """``lines`` with format and event; blank lines go, lines of no format become a message, those that fail to parse go."""
    line = F.col(col)
    rows = lines.where(F.trim(line) != "").withColumn("format", F.lit(fmt) if fmt else detect_format(line))

    def of(x: Column) -> Column:
        raw = _event(message=F.trim(x), event_type=F.lit("unknown"), source=F.lit("raw"))
        f = F.col("format")
        return F.when(f == "json", parse_json(x, year)).when(f == "cef", parse_cef(x)).when(f == "auditd", parse_auditd(x)).when(f == "syslog", parse_syslog(x, year)).otherwise(raw)

    # an array of one event, or of none where the parser fails: exploding it evaluates the parsers once a line
    events = F.array_compact(F.transform(F.array(line), of))
    return rows.withColumn("event", F.explode(events))


#: Other names of actions and protocols.
ACTIONS = {"execve": "exec", "clone": "fork", "openat": "open", "logon": "login", "logoff": "logout"}
PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp"}


def _renamed(c: Column, names: dict[str, str]) -> Column:
    out = c
    for a, b in names.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def normalize_events(events: DataFrame) -> DataFrame:
    """Plain messages, usual actions and protocols, lower users and hosts, bare process names, severities as words."""
    number = F.col("severity").try_cast("int")
    severity = F.when(number <= 2, "low").when(number <= 5, "medium").when(number <= 7, "high").when(number.isNotNull(), "critical").otherwise(F.lower("severity"))
    changed = {
        "message": F.trim(F.regexp_replace("message", "\x1b\\[[0-9;]*m", "")),
        "action": _renamed(F.lower("action"), ACTIONS),
        "protocol": _renamed(F.lower("protocol"), PROTOCOLS),
        "user": F.lower("user"),
        "host": F.lower("host"),
        "process": F.substring_index(F.replace("process", F.lit("\\"), F.lit("/")), "/", -1),
        "severity": severity,
    }
    return events.withColumns({k: v for k, v in changed.items() if k in events.columns})


#: Indicator types by pattern, in the order in which they are tried.
IOC_PATTERNS = (
    ("url", r"(?i)^https?://"), ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}(?::.*)?$"), ("ip", r"^[0-9a-fA-F:]+:[0-9a-fA-F:]+$"),
    ("hash_md5", r"^[a-fA-F0-9]{32}$"), ("hash_sha1", r"^[a-fA-F0-9]{40}$"), ("hash_sha256", r"^[a-fA-F0-9]{64}$"), ("registry", r"(?i)^HK(?:LM|CU|CR|U|CC)\\"),
    ("domain", r"^(?=.{1,253}$)([a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}$"), ("file_path", r"[/\\]"),
)


def infer_ioc_type(value: Column) -> Column:
    """Null for what looks like no indicator."""
    v, out = F.trim(value), F.lit(None).cast("string")
    for name, pattern in reversed(IOC_PATTERNS):
        out = F.when(v.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def normalize_ioc(kind: Column, value: Column) -> Column:
    """P13."""
    v = F.trim(value)
    one_port = (F.char_length(v) - F.char_length(F.replace(v, F.lit(":"), F.lit("")))) == 1
    domain = F.regexp_replace(F.regexp_replace(F.lower(v), r"^\.+", ""), r"^www\.", "")
    return F.when(kind.startswith("hash_") | (kind == "email"), F.lower(v)).when(kind == "domain", domain).when((kind == "ip") & one_port, F.substring_index(v, ":", 1)).otherwise(v)


def ioc_fingerprint(kind: Column, value: Column) -> Column:
    """P14."""
    return F.substring(F.sha1(F.concat_ws("|", kind, value)), 1, 16)
