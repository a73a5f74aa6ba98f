"""Secrets in texts: fixed forms, and strings of high entropy.

Fixed forms are an assignment to a telling name, an access key and a long run of hex
digits. Beside them every candidate string (a long run of key characters) is judged by the
Shannon entropy of a window that slides over it: the counts of the window's characters are
kept up to date by the one that enters and the one that leaves. Each character class has a
threshold of its own, and every candidate has a class; what the allow-list names is left
alone, and plain words and numbers stay below their threshold.
All of it is built-in expressions; spans are in code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import bind, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # matches of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"  # matches of [0-9a-f]+ with 32 characters or more
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: runs of key characters, as long as the window at least.
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes, first match counts: name, pattern of the whole candidate, least entropy in bits of a window.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.5),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.6),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", 3.5),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", 3.7),
    # long words and names of constants; numbers stay below it, as ten digits have 3.33 bits at most
    ("other", r"^", 3.7),
)
#: Never secrets: UUIDs, paths, words joined by hyphens or underscores, one character again and again.
#: Repeated groups are possessive: Java matches those in a loop, others by a call for each repeat.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?(?:[a-z]++[/_-])++[a-z]*+[0-9]{0,4}$",
    r"^(.)\1*+$",
)


def _parts(matches: Column, between: Column) -> Column:
    """Start and end of every match, from the matches and what stands between them."""

    def step(state, pair):
        start = state["at"] + F.char_length(pair["between"])
        stop = start + F.char_length(pair["match"])
        found = F.concat(state["spans"], F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))))
        return F.struct(stop.cast("int").alias("at"), found.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    pairs = F.arrays_zip(matches.alias("match"), F.slice(between, F.lit(1), F.size(matches)).alias("between"))
    return F.aggregate(pairs, zero, step)["spans"]


def spans_of(text: Column, pattern: str) -> Column:
    """Spans of all leftmost matches, as an array of (match, start, stop)."""

    def of(matches):
        spans = _parts(matches, F.split(text, pattern, -1))
        pairs = F.arrays_zip(matches.alias("match"), spans.alias("span"))
        full = F.transform(pairs, lambda p: F.struct(p["match"].alias("match"), p["span"]["start"].alias("start"), p["span"]["stop"].alias("stop")))
        return F.when(F.size(matches) > 0, full).otherwise(F.array().cast("array<struct<match:string,start:int,stop:int>>"))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of a window over a candidate, 0 if it is shorter than the window.

    The state holds the window's counts and the sum of c * log2(c) over them; a step adds
    the terms of the character that enters and takes off those of the one that leaves.
    """
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def fold(characters):
        def step(state, i):
            new = F.get(characters, i)
            old = F.when(i >= window, F.get(characters, i - window)).otherwise(F.lit(-1))
            counts = state["counts"]
            left = F.coalesce(F.get(counts, old), F.lit(0))
            less = F.when(old >= 0, term(left - 1) - term(left)).otherwise(F.lit(0.0))
            before = F.get(counts, new) - F.when(old == new, 1).otherwise(0)
            total = state["total"] + less + term(before + 1) - term(before)
            moved = F.transform(counts, lambda c, k: (c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0)).cast("int"))
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(moved.alias("counts"), total.alias("total"), F.greatest(state["best"], bits).alias("best"))

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")
        )
        steps = F.sequence(F.lit(0), F.size(characters) - 1)
        return F.round(F.aggregate(steps, start, step)["best"], 9)

    characters = F.transform(F.split(candidate, ""), lambda c: F.when(c == "", -1).otherwise(F.call_function("locate", c, F.lit(ALPHABET)) - 1).cast("int"))
    return F.when(F.char_length(candidate) >= window, bind(F.filter(characters, lambda k: k >= 0), fold)).otherwise(F.lit(0.0))


def is_secret(candidate: Column) -> Column:
    """A candidate that the allow-list does not name and whose entropy reaches its class's threshold."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed | least.isNull(), F.lit(False)).otherwise(window_entropy(candidate) >= least)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``spans`` (kind, start, stop; by start, then kind) of every row.

    Fixed forms are leftmost and non-overlapping within their kind. A string of high entropy
    counts unless it overlaps one of them. Null and empty texts have no spans; equal rows
    have equal spans; only the id and the text are read.
    """
    text = text_or_empty(text_column)
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    found = docs.select(F.col(id_column), text.alias("text")).select(
        F.col(id_column),
        F.filter(spans_of(F.col("text"), ASSIGN), lambda s: F.char_length(value(s["match"])) >= 8).alias("assign"),
        spans_of(F.col("text"), ACCESS).alias("access"),
        spans_of(F.col("text"), HEX).alias("hex"),
        F.filter(spans_of(F.col("text"), CANDIDATE), lambda s: is_secret(s["match"])).alias("candidates"),
    )
    fixed = F.concat("assign", "access", "hex")
    free = F.filter("candidates", lambda c: ~F.exists(fixed, lambda f: (f["start"] < c["stop"]) & (c["start"] < f["stop"])))

    def named(rank, spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind")))

    spans = F.array_sort(F.concat(named(0, F.col("assign")), named(1, F.col("access")), named(2, F.col("hex")), named(3, free)))
    return found.select(id_column, F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<kind>``; of overlapping spans the first counts."""

    def step(state, span):
        free = span["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit("<"), span["kind"], F.lit(">"))
        return F.struct(
            F.when(free, span["stop"]).otherwise(F.greatest(state["at"], span["stop"])).alias("at"), F.when(free, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out")
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return bind(F.aggregate(spans, zero, step), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the fixed forms, the hash of their spans, and all spans as a string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    fixed = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(id_column, *[count(k) for k in KINDS], F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
