"""Column functions on event text: masking, ids, labels, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference: label texts and cut marks.
UNKNOWN_LABEL = "Desconhecido"
FAILURE_LABEL = "Failure!!!"
CUT_MARKS = ["Traceback (most recent call last):", "None File", "None None"]

# Characters that a blank strip removes: every Unicode blank.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Variable parts of a raw message, masked in this order.
MASK_RULES = [
    r"blk_-?[0-9]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?",
    r"(/[A-Za-z0-9_.-]+)+",
    r"0x[0-9a-fA-F]+",
    r"-?[0-9]+(\.[0-9]+)?",
]

# Failure classes named by the reference.  It ships the names, not the patterns:
# the patterns are this repository's assumption.  First match wins.
HDFS_RULES = [
    (r"InterruptedIOException", "InterruptedIOException"),
    (r"SocketTimeoutException", "SocketTimeoutException"),
    (r"EOFException", "EOFException"),
    (r"(NameSystem|BlockMap)", "NameSystem/BlockMap"),
    (r"([Ee]xception|[Ee]rror)", "Other Exception"),
]
OPENSTACK_RULES = [
    (r"Too many open files", "Infrastructure: resource exhaustion"),
    (r"(Name or service not known|DNS|getaddrinfo)", "Infrastructure: DNS resolution"),
    (r"(not ready|HTTP 400)", "Network: not ready"),
    (r"[Ii]nfo[ _][Cc]ache", "Network: info cache"),
    (r"KeyError.*device_path", "Storage: device mapping"),
    (r"([Dd]eprecat|cinder.*v2)", "Storage: API deprecation"),
    (r"([Dd]etach|[Vv]olume)", "Storage: volume inconsistency"),
    (r"AttributeError", "Application: metadata"),
    (r"TypeError", "Application: logic"),
    (r"(NoValidHost|could not be found)", "Application: lookup"),
    (r"([Rr]eboot|[Ss]hutdown|ACPI)", "Application: restart"),
    (r"^Failure", "Application: generic failure"),
]
BGL_RULES = [
    (r"([Nn]etwork|[Ss]ocket|[Tt]orus|[Ll]ink)", "Network"),
    (r"(I/O|ciod|[Ff]ile|[Rr]ead|[Ww]rite)", "I/O"),
    (r"([Kk]ernel|[Ss]ystem|[Pp]anic|interrupt)", "System/Kernel"),
]


def null_event(event: Column, fill: str = "") -> Column:
    return F.coalesce(event, F.lit(fill))


def short_desc(text: Column, n: int = 50, dots: bool = True) -> Column:
    """First ``n`` characters of a description."""
    cut = F.substring(text, 1, n)
    return F.concat(cut, F.lit("...")) if dots else cut


def pattern_hash(text: Column, n: int = 50) -> Column:
    """Eight hex digits that name a failure pattern."""
    return F.substring(F.md5(short_desc(text, n, dots=False)), 1, 8)


def event_id(template: Column) -> Column:
    """Stable eight-hex id of a template."""
    return F.substring(F.md5(template), 1, 8)


def strip(text: Column, chars: str = BLANKS) -> Column:
    return F.btrim(text, F.lit(chars))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), 0)


def short_label_os(raw: Column) -> Column:
    """Short label of a raw error message, OpenStack rules."""

    def cut_at_mark(text: Column) -> Column:
        body = text
        for mark in reversed(CUT_MARKS):  # the first listed mark wins, so it is tested last
            at = F.instr(text, mark)
            body = F.when(at > 1, strip(F.left(text, at - 1))).otherwise(body)
        return body

    def first_line(body: Column) -> Column:
        line = strip(F.substring_index(body, "\n", 1))
        dots = F.when(F.length(body) > 120, F.lit("...")).otherwise(F.lit(""))
        return F.concat(_once(line, shorten), dots)

    def shorten(line: Column) -> Column:
        colon = F.instr(line, ":") - 1
        cut = F.when((colon > 0) & (colon < 100), F.left(line, colon + 60)).otherwise(F.left(line, F.lit(120)))
        return strip(F.when(F.length(line) > 120, cut).otherwise(line), ' "')

    def label(text: Column) -> Column:
        failed = F.startswith(text, F.lit("Failure"))
        return F.when(failed, F.lit(FAILURE_LABEL)).otherwise(_once(cut_at_mark(text), first_line))

    return F.coalesce(_once(strip(strip(raw), '"'), label), F.lit(UNKNOWN_LABEL))


def short_label_hdfs(raw: Column, n: int = 100) -> Column:
    """Short label of a raw error message, HDFS rules."""
    text = strip(raw)
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return F.coalesce(F.when(F.length(text) > n, cut).otherwise(text), F.lit(UNKNOWN_LABEL))


def mask_template(message: Column, rules: list[str] = MASK_RULES) -> Column:
    """Replace the variable parts of a raw message by ``<*>``."""
    for rule in rules:
        message = F.regexp_replace(message, rule, "<*>")
    return message


def categorize(text: Column, rules: list[tuple[str, str]], default: str = "Other") -> Column:
    """Name of the first rule whose pattern occurs in the text."""
    found = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(default))
