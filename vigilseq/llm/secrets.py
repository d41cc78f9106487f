"""Secrets in texts: fixed forms, and strings whose sliding windows have high entropy.

Fixed forms are assignments to a credential name, access keys and long hex strings.
To them the entropy scan adds spans: candidate strings of a character class are read
with a window of ``WINDOW`` characters.  The window's character counts are kept in an
array; a step takes one character out, puts one in, and changes the sum of
``n log2 n`` by these two counts alone.  Windows with enough entropy are joined to spans.
The allow list takes out single windows: those without a digit (words, paths of words),
those of digits and signs alone (numbers, dates) and those that touch a placeholder word;
the rest of their candidate is still scanned.  A candidate that is an identifier as a
whole is left out, and so are spans inside a span of a fixed form.

Candidates are read in pieces of ``PIECE`` windows, each as an array of symbols, so the work
grows with the length of a candidate.

All of it is column expressions on the row of a document: no shuffle, and no state beyond
the row.  Texts that no pattern can match are passed over by one search per kind.

Positions count code points, ends are exclusive.  Null texts are empty.  A document
without findings has counts of zero, an empty span list and the hash of an empty
string.  Every input row gives one row, repeated and null ids included.  Columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed forms (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAME = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

WINDOW = 20
PIECE = 512  # windows of a candidate that are scanned at once
MARK = "\u0001"
TOLERANCE = 1e-9  # rounding of the running sum


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``pattern``; ``alphabet`` are its characters, ``bits`` the least entropy of a window."""

    name: str
    pattern: str
    alphabet: str
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 3.0),
    CharacterClass(
        "entropy_base64", r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7
    ),
)
IDENTIFIER = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"  # no secret
PLACEHOLDERS = ("example", "sample", "placeholder")
BLANK = "~"  # in place of a placeholder's letters; in no alphabet
SIGNS = "+/_-"
KINDS = ("assign", "access", "hex", *[c.name for c in CLASSES])


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each element, in blocks so that long arrays take no square of steps."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def with_blocks(width: Column, sums: Column) -> Column:
        before = F.transform(sums, lambda _, j: total(F.slice(sums, F.lit(1), j)))
        return F.transform(
            lengths, lambda _, i: before[F.floor(i / width).cast("int")] + total(F.slice(lengths, i - i % width + 1, i % width))
        )

    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
        lambda j: total(F.slice(lengths, j * block + 1, block)),
    )
    return _once(sums, lambda s: with_blocks(block, s))


def _found(df: DataFrame, name: str, maybe: Column, pattern: str) -> DataFrame:
    """Add column ``name``: array of (start, end, piece), the matches of ``pattern`` in ``text`` where ``maybe`` holds.

    Matches are put between marks and the text is split at the marks, so every
    second part is a match and the lengths of the parts give its place.
    """
    marked = F.split(F.regexp_replace("text", F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    out = df.withColumn("parts", F.when(maybe, marked).otherwise(F.array(F.lit(""))))
    out = out.withColumn("lengths", F.transform("parts", F.length))
    out = out.withColumn("starts", F.when(F.size("parts") > 1, _starts(F.col("lengths"))).otherwise(F.array(F.lit(0))))
    places = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: i % 2 == 1)
    return out.withColumn(
        name,
        F.transform(
            places,
            lambda i: F.struct(
                F.col("starts")[i].alias("start"),
                (F.col("starts")[i] + F.col("lengths")[i]).alias("end"),
                F.col("parts")[i].alias("piece"),
            ),
        ),
    ).drop("parts", "lengths", "starts")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; a one-element transform binds it."""
    return F.transform(F.array(value), use)[0]


def _grown(spans: Column, begin: Column, end: Column) -> Column:
    """Spans with one more, joined to the last where it touches it."""
    last = F.element_at(spans, -1)
    own = F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], end.cast("int")).alias("end"))
    return (
        F.when(F.size(spans) == 0, F.array(own))
        .when(last["end"] >= begin, F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(wider)))
        .otherwise(F.concat(spans, F.array(own)))
    )


NOTHING = -2  # leaves a window that is not full
NO_SPANS = "cast(array() as array<struct<begin:int,end:int>>)"


def window_spans(candidate: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Spans (begin, end) inside ``candidate`` covered by windows of at least ``bits`` bits of entropy per character."""

    def of_piece(text: Column, begin: Column) -> Column:
        chars = F.slice(F.split(text, ""), F.lit(1), F.length(text))
        symbols = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)
        found = _once(symbols, lambda own: _piece_spans(own, alphabet, bits, window))
        return F.transform(found, lambda s: F.struct((s["begin"] + begin).alias("begin"), (s["end"] + begin).alias("end")))

    def of_pieces(pieces: Column) -> Column:
        """A piece is read together with the beginning of the next, so that every window is in one piece."""
        after = lambda i: F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(window - 1))
        return F.flatten(F.transform(pieces, lambda p, i: _once(F.concat(p, after(i)), lambda text: of_piece(text, i * PIECE))))

    for word in PLACEHOLDERS:
        candidate = F.regexp_replace(candidate, f"(?i){word}", BLANK * len(word))
    spans = _once(F.regexp_extract_all(candidate, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), of_pieces)
    return F.aggregate(spans, F.expr(NO_SPANS), lambda done, s: _grown(done, s["begin"], s["end"]))


def _piece_spans(symbols: Column, alphabet: str, bits: float, window: int) -> Column:
    """Spans of a piece given by its symbols, -1 for a blank."""
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    most = F.lit((math.log2(window) - bits + TOLERANCE) * window)  # of the sum of n log2 n
    zero = alphabet.index("0")

    def digit(symbol: Column) -> Column:
        return F.when((symbol >= zero) & (symbol < zero + 10), 1).otherwise(0)

    def sign(symbol: Column) -> Column:
        return F.when(symbol >= len(alphabet) - len(SIGNS), 1).otherwise(0) if alphabet.endswith(SIGNS) else F.lit(0)

    def blank(symbol: Column) -> Column:
        return F.when(symbol == -1, 1).otherwise(0)

    def step(state: Column, i: Column) -> Column:
        into = symbols[i - 1]
        out = F.when(i > window, F.get(symbols, i - window - 1)).otherwise(F.lit(NOTHING))

        def moved(s: Column) -> Column:
            into, out, counts = s["into"], s["out"], s["state"]["counts"]
            gone = F.when(out >= 0, F.get(counts, out)).otherwise(0)
            come = F.when(into >= 0, F.get(counts, into) - F.when(into == out, 1).otherwise(0)).otherwise(0)
            total = s["state"]["total"] + (weights[come + 1] - weights[come])
            total = total - F.when(out >= 0, weights[gone] - weights[gone - 1]).otherwise(0.0)
            changed = F.transform(counts, lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            return F.struct(
                F.when(into == out, counts).otherwise(changed).alias("counts"),
                total.alias("total"),
                (s["state"]["digits"] + digit(into) - digit(out)).alias("digits"),
                (s["state"]["signs"] + sign(into) - sign(out)).alias("signs"),
                (s["state"]["blanks"] + blank(into) - blank(out)).alias("blanks"),
                s["state"]["spans"].alias("spans"),
                s["i"].alias("i"),
            )

        def marked(s: Column) -> Column:
            plain = (s["digits"] == 0) | (s["digits"] + s["signs"] == window)
            hit = (s["i"] >= window) & (s["total"] <= most) & ~plain & (s["blanks"] == 0)
            spans = F.when(hit, _grown(s["spans"], s["i"] - window, s["i"])).otherwise(s["spans"])
            return F.struct(*[s[c].alias(c) for c in ("counts", "total", "digits", "signs", "blanks")], spans.alias("spans"))

        seen = F.struct(state.alias("state"), into.alias("into"), out.alias("out"), i.alias("i"))
        return _once(_once(seen, moved), marked)

    none = [F.lit(0).alias(c) for c in ("digits", "signs", "blanks")]
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), *none, F.expr(NO_SPANS).alias("spans"))
    return F.aggregate(F.sequence(F.lit(1), F.size(symbols)), start, step, lambda s: s["spans"])


def _of_kind(spans: Column, kind: int, start: str = "start", end: str = "end") -> Column:
    """Sortable spans: by start, then kind as listed."""
    return F.transform(
        spans, lambda s: F.struct(s[start].cast("int").alias("start"), F.lit(kind).alias("kind"), s[end].cast("int").alias("end"))
    )


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return F.array_join(parts, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, found): counts and spans (start, kind, end) per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), F.translate(text, MARK, "\u0002").alias("text"))
    content = F.col("text")
    out = _found(out, "assign", content.rlike(ASSIGN_NAME + r"""["']?\x20*[:=]"""), ASSIGN)
    out = _found(out, "access", content.contains("AKIA"), ACCESS)
    out = _found(out, "hex", content.rlike(r"[0-9a-f]{32}"), HEX)
    for c in classes:
        out = _found(out, c.name, content.rlike(r"[A-Za-z0-9+/_-]{20}"), c.pattern)

    assign = F.filter("assign", lambda m: F.length(F.regexp_extract(m["piece"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    out = out.withColumn("assign", assign)
    out = out.withColumn("base", F.concat(*[_of_kind(F.col(k), i) for i, k in enumerate(KINDS[:3])]))
    added = []
    for number, c in enumerate(classes, 3):
        secret = F.filter(c.name, lambda m: ~m["piece"].rlike(IDENTIFIER))
        spans = F.flatten(
            F.transform(
                secret,
                lambda m: F.transform(
                    window_spans(m["piece"], c.alphabet, c.bits),
                    lambda s: F.struct((m["start"] + s["begin"]).alias("start"), (m["start"] + s["end"]).alias("end")),
                ),
            )
        )
        added.append(_of_kind(spans, number))
    out = out.withColumn("added", F.concat(*added) if added else F.filter("base", lambda s: F.lit(False)))
    outside = F.filter(
        "added", lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]))
    )
    return out.select(
        "id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        "base",
        F.concat("base", outside).alias("found"),
    )


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per document."""
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.col("found")).alias("spans"),
    )
