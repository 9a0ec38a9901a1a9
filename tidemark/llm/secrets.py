"""Secrets in whole texts, in SQL functions only.

Base patterns give the spans of assignments, access keys and hex strings.  Beside them, candidate
strings are scanned with a sliding window whose Shannon entropy is kept up by counts: a fold carries
one count for each character, and when the window moves only those of the leaving and the entering
character change, so the sum of c*log2(c) changes by two table entries.  The table is in whole
numbers (1e-9 bits): no rounding builds up along a string.  Work is linear in a text's and in a
candidate's length: matches come as strings, places as running sums over blocks.  Each character class has a threshold of its own; a candidate's
added span runs from its first to its last window at or over it.  Candidates that match the
allow-list, or that overlap a base span, add nothing.

Defined cases: a null text counts as empty and has no spans (and stays null when redacted); spans
are in code points, end exclusive; rows with equal doc_id each give a row; an empty table gives no
rows; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SPAN = "array<struct<start:int,kind:int,end:int>>"
UNIT = 1_000_000_000


@dataclass(frozen=True)
class EntropyRule:
    """What the sliding window takes for a secret."""

    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    window: int = 20
    #: (what the whole candidate matches, bits a character); the first class that fits counts
    classes: tuple[tuple[str, float], ...] = ((r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.75), (r"^[A-Za-z0-9+/_=-]+$", 3.75))
    #: candidates in which the first of a pair is found and the second is not are no secrets (without groups that repeat: these take a stack as deep as the text)
    allowed: tuple[tuple[str, str | None], ...] = field(
        default=(
            (r"^[^0-9]*$", None),  # no digit: words
            (r"^[^A-Za-z]*$", None),  # no letter: numbers
            (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", None),  # UUID
            (r"(?i)example|sample|placeholder|dummy|changeme", None),
            (r"(?i)0123456789|abcdefghijkl|qwertyuiop", None),
            (r"[-_/=+]", r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}|[-_/=+]{2}|^[-_/=+]|[-_/=+]$"),  # paths and dated names: words or up to four digits between single marks
        )
    )


#: Folds that build a list do so in blocks of so many, as a list is copied when it grows.
BLOCK = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(a: Column) -> Column:
    """An array's elements in consecutive arrays of BLOCK."""
    n = F.ceil(F.size(a) / F.lit(BLOCK)).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK)))


def _running(a: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each number of an array what those before it come to, from 0."""

    def fold(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(values, start, lambda s, x: F.struct(combine(s["now"], x).cast("int").alias("now"), F.array_append(s["before"], s["now"]).alias("before")))

    def shifted(parts: Column) -> Column:
        over = fold(F.transform(parts, lambda p: p["now"]))["before"]
        return F.flatten(F.zip_with(parts, over, lambda p, o: F.transform(p["before"], lambda x: combine(o, x).cast("int"))))

    return _let(F.transform(_blocks(a), fold), shifted)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places and strings: what lies between them and their own lengths add up."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(z: Column) -> Column:
        gaps = F.transform(F.slice(z["between"], 1, F.size(z["found"])), F.length)
        steps = F.zip_with(gaps, z["found"], lambda g, m: g + F.length(m))
        starts = F.zip_with(_running(steps, _sum), gaps, _sum)
        return F.zip_with(starts, z["found"], lambda a, m: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("said")))

    return _let(F.struct(found.alias("found"), between.alias("between")), placed)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))).cast(SPAN)


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns by start, then kind.  Short matches still use up their characters, and go."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(F.filter(F.arrays_zip(_spans(_matches(text, ASSIGN), 0).alias("span"), values.alias("value")), lambda z: F.length(z["value"]) >= 8), lambda z: z["span"]).cast(SPAN)
    parts = [
        F.when(text.rlike(ASSIGN_HEAD), long_enough).otherwise(_none()),
        F.when(text.contains("AKIA") & text.rlike(ACCESS), _spans(_matches(text, ACCESS), 1)).otherwise(_none()),
        F.when(text.rlike("[0-9a-f]{32}"), _spans(_matches(text, HEX), 2)).otherwise(_none()),
    ]
    return F.array_sort(F.concat(*parts))


def _gains(n: int) -> Column:
    """What c * log2(c) grows by, in whole units, when the count goes from c to c + 1, for c from 0 to n."""
    of = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(n + 2)]
    return F.array(*[F.lit(b - a).cast("long") for a, b in zip(of, of[1:], strict=False)])


def _windows(text: Column, limit: Column, w: int) -> Column:
    """(first, last) start of the windows whose sum of c*log2(c) is at most ``limit``; nulls where none is.

    ``text`` is ASCII.  The counts stand in a string, one letter for each character from "!" to "z": A for none, B for one ...
    """
    gains = _gains(w)

    def scan(z: Column) -> Column:
        place = lambda i: F.ascii(F.substr(z["raw"], i + 1, F.lit(1)).cast("string")) - 32
        count = lambda s, p: F.ascii(F.substr(s["counts"], p, F.lit(1))) - 65
        put = lambda counts, p, c: F.overlay(counts, F.char(c + 65), p, F.lit(1))
        none = F.lit(None).cast("int")
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit("A" * 96).alias("counts"), none.alias("first"), none.alias("last"))

        def reached(s: Column, i: Column) -> tuple[Column, Column]:
            """first and last with the window that ends before i."""
            ok = (i >= w) & (s["sum"] <= z["limit"])
            return F.when(ok, F.coalesce(s["first"], i - w)).otherwise(s["first"]), F.when(ok, i - w).otherwise(s["last"])

        def step(s: Column, i: Column) -> Column:
            new, old = place(i), place(i - w)
            a, b = count(s, new), count(s, old)
            more, counts = s["sum"] + F.get(gains, a), put(s["counts"], new, a + 1)
            total = F.when(i < w, more).when(new == old, s["sum"]).otherwise(more - F.get(gains, b - 1))
            counts = F.when(i < w, counts).when(new == old, s["counts"]).otherwise(put(counts, old, b - 1))
            first, last = reached(s, i)
            return F.struct(total.alias("sum"), counts.alias("counts"), first.alias("first"), last.alias("last"))

        def finish(s: Column) -> Column:
            first, last = reached(s, z["n"])
            return F.struct(first.alias("first"), last.alias("last"))

        return F.aggregate(F.sequence(F.lit(0), z["n"] - 1), start, step, finish)

    return _let(F.struct(F.encode(text, "utf-8").alias("raw"), limit.alias("limit"), F.length(text).alias("n")), scan)


def entropy_spans(text: Column, base: Column, rule: EntropyRule = EntropyRule()) -> Column:
    """Added spans: high-entropy stretches of candidates that are neither allowed nor touched by a base span."""
    w = rule.window

    def limit_of(s: Column) -> Column:
        found = F.lit(None).cast("long")
        for pattern, bits in reversed(rule.classes):
            found = F.when(s.rlike(pattern), F.lit(round((w * math.log2(w) - w * bits) * UNIT)).cast("long")).otherwise(found)
        return found

    def free(blocks: Column) -> Column:
        """Candidates that are not allowed and that no base span touches; base spans are by start, in blocks with their least start and greatest end."""

        def wanted(m: Column) -> Column:
            ok = F.lit(True)
            for found, missing in rule.allowed:
                ok = ok & ~(m["said"].rlike(found) & ~m["said"].rlike(missing) if missing else m["said"].rlike(found))
            touch = lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
            return ok & ~F.exists(blocks, lambda b: touch(b) & F.exists(b["spans"], touch))

        return F.filter(_matches(text, rule.candidate), wanted)

    blocks = F.transform(_blocks(base), lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans")))

    def narrowed(m: Column) -> Column:
        return _let(_windows(m["said"], limit_of(m["said"]), w), lambda f: F.struct((m["start"] + f["first"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + f["last"] + w).alias("end")))

    some = F.filter(F.transform(_let(blocks, free), narrowed).cast(SPAN), lambda s: s["start"].isNotNull())
    return F.when(text.rlike(rule.candidate), some).otherwise(_none())


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.select("doc_id", "base", F.array_sort(F.concat("base", entropy_spans(F.col("text"), F.col("base"), rule))).alias("all"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("all")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """The documents with every span's text replaced by a mark, and n_chars of the new text."""
    names = docs.columns
    # the names that are added are none of the input's
    base, spans = _free("base", names), _free("spans", names)
    text = F.col("text")
    rows = docs.withColumn(base, F.when(text.isNotNull(), base_spans(text)))
    rows = rows.withColumn(spans, F.when(text.isNotNull(), F.array_sort(F.concat(F.col(base), entropy_spans(text, F.col(base), rule)))))

    def marked(z: Column) -> Column:
        # spans by start; each leaves what lies between it and the furthest end before it, and a mark unless it begins inside
        furthest = _running(F.transform(z["spans"], lambda x: x["end"]), F.greatest)
        cut = lambda first, last: F.array_join(F.slice(z["chars"], first + 1, F.greatest(last - first, F.lit(0))), "")
        parts = F.zip_with(z["spans"], furthest, lambda x, at: F.when(x["start"] >= at, F.concat(cut(at, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(z["spans"], lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), cut(end, F.size(z["chars"])))

    clean = _free("clean", names)
    found = _let(F.struct(F.col(spans).alias("spans"), F.split(text, "", -1).alias("chars")), marked)
    rows = rows.withColumn(clean, F.when(F.size(F.col(spans)) > 0, found))
    new = {"text": F.coalesce(F.col(clean), text)}
    if "n_chars" in names:
        new["n_chars"] = F.coalesce(F.length(F.col(clean)), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def _free(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _places(name: str, pattern: str, kind: int) -> str:
    """CTE with the spans of all matches of a pattern in table d: what lies between matches and their lengths add up."""
    p = _quoted(pattern)
    return f"""{name}_m AS (SELECT row, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS parts, text FROM d WHERE regexp_matches(text, {p})),
{name}_a AS (SELECT row, i, m[i] AS s, list_sum(list_transform(parts[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS a FROM {name}_m, unnest(range(1, len(m) + 1)) AS t(i)),
{name} AS (SELECT row, i, s, CAST(a AS BIGINT) AS a, {kind} AS kind, CAST(a + length(s) AS BIGINT) AS b FROM {name}_a)"""


def _oracle(rule: EntropyRule = EntropyRule()) -> str:
    w = rule.window
    table = ", ".join(str(round(c * math.log2(c) * UNIT) if c else 0) for c in range(w + 1))
    limit = " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN {round((w * math.log2(w) - w * bits) * UNIT)}" for p, bits in rule.classes)
    allowed = " AND ".join(f"NOT (regexp_matches(s, {_quoted(p)}){f' AND NOT regexp_matches(s, {_quoted(q)})' if q else ''})" for p, q in rule.allowed)
    names = ", ".join(_quoted(k) for k in KINDS)
    said = f"string_agg(list_extract([{names}], kind + 1) || ':' || a || ':' || b, ',' ORDER BY a, kind, b)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
{_places("assign0", ASSIGN, 0)}, {_places("access", ACCESS, 1)}, {_places("hexes", HEX, 2)}, {_places("candidates", rule.candidate, 3)},
assign AS (SELECT x.* FROM assign0 x JOIN d USING (row) WHERE length(regexp_extract_all(text, {_quoted(ASSIGN)}, 2)[i]) >= 8),
base AS (SELECT row, a, kind, b FROM assign UNION ALL SELECT row, a, kind, b FROM access UNION ALL SELECT row, a, kind, b FROM hexes),
wanted AS (SELECT row, s, a, CASE {limit} END AS most FROM candidates c WHERE {allowed} AND NOT EXISTS (SELECT 1 FROM base WHERE base.row = c.row AND base.a < c.b AND c.a < base.b)),
windows AS (SELECT row, a, most, i, substr(s, i + 1, {w}) AS x FROM wanted, unnest(range(0, length(s) - {w - 1})) AS t(i)),
sums AS (SELECT *, list_sum(list_transform(list_distinct(string_split(x, '')), lambda ch: list_extract([{table}], {w} - length(replace(x, ch, '')) + 1))) AS total FROM windows),
added AS (SELECT row, CAST(a + min(i) AS BIGINT) AS a, 3 AS kind, CAST(a + max(i) + {w} AS BIGINT) AS b FROM sums WHERE total <= most GROUP BY row, sums.a),
one AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {said} AS s FROM base GROUP BY 1),
two AS (SELECT row, {said} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(one.s, '')) AS base_sha256, coalesce(two.s, '') AS spans
FROM d LEFT JOIN one USING (row) LEFT JOIN two USING (row)
"""


ORACLE_SQL = _oracle()
