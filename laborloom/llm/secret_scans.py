"""Secret scans: patterns for single secrets, linking for secrets in several parts.

Base patterns stand alone. Weaker candidates (account names, unlabelled mixed
tokens, service addresses) mean nothing by themselves and are reported only
when a complementary part lies in the same scope: an identifier with a secret,
or an endpoint with either, both starting within ``reach`` characters and not
overlapping, so that an address which holds a hash is no credential by itself.
The parts meet in an interval join on (text, stretch of ``reach`` characters,
role) against the spans of that role that start in the stretch, which its length
bounds.

Offsets are code points, ends exclusive; a span is the whole match. Edge cases:
null and empty texts have no spans; overlapping spans of different kinds all
stay; a row's spans depend on its text alone, so equal texts have equal spans and
a null or repeated doc_id changes nothing; the work on a text is linear in its
length but for a thousandth part of the square of its matches; other columns pass
through, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import let, saved


@dataclass(frozen=True)
class Pattern:
    """What to find, which group must have how many characters, what else the match must contain, its role."""

    kind: str
    regex: str
    group: int
    least: int
    role: str
    holds: tuple[str, ...] = ()


# The contract's three patterns. A run of 24 or more is found alike with or without the bound in the
# pattern, and with it ordinary text gives no short runs to drop; the first pattern's short matches do hide later ones.
BASE = (
    Pattern(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        "secret",
    ),
    Pattern("access", "AKIA[A-Z0-9]{16,}", 0, 20, "identifier"),
    Pattern("hex", "[0-9a-f]{24,}", 0, 24, "secret"),
)
# Candidates that need a partner.
WEAK = (
    Pattern(
        "account",
        "(?:client_?id|user(?:name)?|login|account)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)",
        1,
        3,
        "identifier",
    ),
    Pattern(
        "mixed",
        "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}",
        0,
        20,
        "secret",
        ("[a-z]", "[A-Z]", "[0-9]"),
    ),
    Pattern(
        "endpoint",
        "(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
        0,
        10,
        "endpoint",
    ),
)
ALL = BASE + WEAK
PARTNERS = {
    "identifier": ("secret", "endpoint"),
    "secret": ("identifier", "endpoint"),
    "endpoint": ("identifier", "secret"),
}
SPAN = "struct<start:int,rank:int,end:int>"
CHUNK = 1000  # matches put together at once
CUT = 4096  # characters of a cut when a text is put together anew


def spans_of(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """Every match of the patterns that is long enough, as an unsorted array of (start, rank in ALL, end)."""
    return F.concat(*[_spans_of(text, p, ALL.index(p)) for p in patterns])


def _spans_of(text: Column, p: Pattern, rank: int) -> Column:
    none = F.array().cast(f"array<{SPAN}>")

    def passes(hit: Column) -> Column:
        counted = F.regexp_extract(hit, p.regex, p.group) if p.group else hit
        return reduce(lambda a, b: a & b, [hit.rlike(h) for h in p.holds], F.char_length(counted) >= p.least)

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end = start + F.coalesce(F.char_length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        spans = F.when(passes(piece["hit"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def located(hits: Column) -> Column:
        # Gaps and matches alternate, so running lengths give the places.
        pieces = F.zip_with(
            F.split(text, p.regex, -1), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit"))
        )

        def chunk(given: Column, state: Column, k: Column) -> Column:
            begin = F.struct(state["at"].alias("at"), none.alias("spans"))
            done = F.aggregate(F.slice(given, k * CHUNK + 1, F.lit(CHUNK)), begin, step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["parts"], F.array(d["spans"])).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
        numbers = F.sequence(F.lit(0), F.floor(F.size(hits) / CHUNK).cast("int"))
        return let(pieces, lambda given: F.aggregate(numbers, start, lambda s, k: chunk(given, s, k), lambda s: F.flatten(s["parts"])))

    hits = F.regexp_extract_all(text, F.lit(p.regex), 0)
    return let(hits, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(none))


def linked_spans(parts: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Weak spans with a complementary part in scope, one array per row key.

    ``parts``: keys and ``spans``, the base and weak spans of a text.
    """
    role = F.element_at(F.array(*[F.lit(p.role) for p in ALL]), F.col("rank") + 1)
    each = parts.select(*keys, F.explode("spans").alias("span")).select(*keys, "span.*")
    each = each.withColumns({"role": role, "stretch": F.floor(F.col("start") / reach)})
    # At most as many as the stretch has characters, for each kind.
    there = each.groupBy(*keys, "stretch", "role").agg(F.collect_set(F.struct("start", "end")).alias("there"))
    wanted = F.element_at(
        F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("role")
    )
    probes = (
        each.filter(F.col("rank") >= len(BASE))
        .select(*keys, "start", "rank", "end", "stretch", F.explode(wanted).alias("role"))
        .withColumn("stretch", F.explode(F.array(*[F.col("stretch") + d for d in (-1, 0, 1)])))
    )

    def complements(x: Column) -> Column:
        near = F.abs(x["start"] - F.col("start")) <= reach
        return near & ((x["end"] <= F.col("start")) | (x["start"] >= F.col("end")))

    met = probes.join(there, [*keys, "stretch", "role"]).filter(F.exists("there", complements))
    return met.groupBy(*keys).agg(F.collect_set(F.struct("start", "rank", "end")).alias("__linked"))


def find_secrets(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (base and linked), sorted by start and kind.

    A first pass keeps the parts of the few texts with weak candidates; the second adds what was linked to each
    row. The linked table is staged, so Spark knows its size and broadcasts it only where that is small.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # 128 bits of the text itself.
    marks = {"__mark": F.xxhash64(F.lit(1), F.col(text)), "__mark2": F.xxhash64(F.lit(2), F.col(text))}
    weak = docs.select(*[c.alias(n) for n, c in marks.items()], body.alias("__body"), spans_of(body, WEAK).alias("__weak"))
    parts = (
        weak.filter(F.size("__weak") > 0)
        .select(*marks, F.concat("__weak", spans_of(F.col("__body"), BASE)).alias("spans"))
        .filter(F.size("spans") > 1)
        .dropDuplicates([*marks])
    )
    linked = saved(linked_spans(parts, [*marks], reach), "linked_secrets")
    rows = docs.withColumns({**marks, "base_spans": F.sort_array(spans_of(body, BASE))})
    added = F.coalesce(F.col("__linked"), F.array().cast(f"array<{SPAN}>"))
    joined = rows.join(linked, [*marks], "left")
    return joined.withColumn("secret_spans", F.sort_array(F.concat("base_spans", added))).drop(*marks, "__linked")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in order."""
    kinds = F.array(*[F.lit(p.kind) for p in ALL])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    rank = next(n for n, p in enumerate(ALL) if p.kind == kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced; null stays null.

    The text is cut once and written out in chunks, so a span costs its own length.
    """
    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def piece(given: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
        return F.substring(F.concat_ws("", F.slice(given, first + 1, last - first + 1)), start - first * CUT + 1, end - start)

    def written(given: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            fresh = (span["start"] >= state["at"]) & (span["end"] > state["at"])
            gap = piece(given, state["at"], F.greatest(span["start"], state["at"]))
            out = F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

        def chunk(state: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(spans, k * CHUNK + 1, F.lit(CHUNK)), F.struct(state["at"].alias("at"), F.lit("").alias("out")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["parts"], F.array(d["out"])).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int"))
        rest = lambda s: F.concat(F.array_join(s["parts"], ""), piece(given, s["at"], F.char_length(text)))
        return F.aggregate(numbers, start, chunk, rest)

    return F.when(F.size(spans) > 0, let(cuts, written)).otherwise(text)
