"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only. Three base kinds (assign, access, hex) are found by pattern; the entropy kind
adds candidate strings, maximal runs of [A-Za-z0-9+/_=-] of 20 or more, that hold a window of 20 characters
whose entropy reaches the limit of the candidate's character class (CLASSES). A window's entropy is
log2(20) - S/20 with S the sum of c*log2(c) over its character counts c. The counts, five bits each, and S
travel with the window: a step takes the leaving character from them and adds the entering one, in whole
numbers, so nothing is counted again and nothing drifts. Candidates on the allow list (no digit, digits
only, a separated path or word list, or a placeholder word) and those that overlap a base span add nothing.
Base spans always stay.

Spans are gathered in chunks of bounded length, so that a text with very many costs hardly more per span.

Defined cases: a null text counts as empty; an empty text has no spans, and its base_sha256 is that of
the empty string; an empty table gives an empty result; ids may be null or repeat (one row per row in).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "entropy"]
WINDOW, CANDIDATE = 20, r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes, the first that fits counts, with the least entropy in bits of a window.
CLASSES = [(r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.8), (r"^[A-Za-z0-9+/=]+$", 3.9), (r"", 4.0)]
#: A candidate that matches any of these is not reported by entropy.
ALLOW = [r"^[^0-9]*$", r"^[0-9]*$", r"^[0-9_=/+-]*$", r"(?i)example|sample|placeholder|changeme|x{6}|dummy|redacted", r"^[A-Za-z_/=+-]*[0-9]{0,4}$"]
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Spans gathered at once.
CHUNK = 256
#: Counts of characters: the first character's code, bits of a count, counts in a long, longs. Parts of a bit of S.
FIRST, BITS, IN_LONG, LONGS, UNIT = 43, 5, 12, 7, 1 << 40


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chunks(items: Column) -> Column:
    """An array (a lambda variable) as an array of chunks."""
    many = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(many, lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())


def located(text: Column, pattern: str, kind: int, kept: Callable[[Column], Column] | None = None, value_group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, from the text between them and their own lengths.

    The gap pattern is tied to the end of the match before (\\G), so a text is passed over once.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)(?:{pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else match
    ok = kept or (lambda v: F.lit(True))
    steps = F.transform(
        F.arrays_zip(gap.alias("gap"), match.alias("match"), value.alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), ok(x["value"]).alias("ok")),
    )

    def spans(part: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["match"]
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def gathered(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["gap"] + x["match"]))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        pairs = F.arrays_zip(parts.alias("part"), begins.alias("begin"))
        return F.flatten(F.transform(F.filter(pairs, lambda z: z["part"].isNotNull()), lambda z: spans(z["part"], z["begin"])))

    none = F.array().cast(SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(steps, lambda s: bound(chunks(s), gathered))).otherwise(none)


def clear_of(spans: Column, others: Column) -> Column:
    """The spans (lambda variables, both in order of their starts) that overlap none of the others."""
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    around = lambda part: F.struct(
        F.element_at(part, 1)["start"].alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"), part.alias("items")
    )

    def cleared(part: Column, groups: Column) -> Column:
        near = F.flatten(F.transform(F.filter(groups, lambda g: meet(g, part)), lambda g: F.filter(g["items"], lambda b: meet(b, part))))
        return bound(near, lambda b: F.filter(part["items"], lambda x: ~F.exists(b, lambda y: meet(y, x))))

    groups = lambda x: F.transform(chunks(x), around)
    return bound(groups(others), lambda g: F.flatten(F.transform(groups(spans), lambda part: cleared(part, g))))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) over the windows of `width` characters of s, by incremental counts.

    The characters must be those of candidates; a string shorter than the window has entropy 0.
    """
    powers = F.array(*[F.lit(1 << BITS * i).cast("long") for i in range(IN_LONG)])
    cost = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(width + 2)])
    power = lambda c: F.element_at(powers, c % IN_LONG + 1)
    place = lambda c: F.floor(c / IN_LONG).cast("int")
    mask = (1 << BITS) - 1
    count = lambda held, c: F.call_function("shiftright", F.element_at(held, place(c) + 1), c % IN_LONG * BITS).bitwiseAND(mask).cast("int")
    saved = lambda n: F.element_at(cost, n + 1)

    def best(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, full = F.element_at(codes, i), i > width
            old = F.element_at(codes, F.greatest(i - width, F.lit(1)))
            n_old = count(acc["held"], old)
            n_new = count(acc["held"], new) - F.when(full & (old == new), 1).otherwise(0)
            total = acc["s"] + F.when(full, saved(n_old - 1) - saved(n_old)).otherwise(0) + saved(n_new + 1) - saved(n_new)
            held = F.transform(
                acc["held"],
                lambda x, j: x + F.when(j == place(new), power(new)).otherwise(0) - F.when(full & (j == place(old)), power(old)).otherwise(0),
            )
            least = F.when(i >= width, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(held.alias("held"), total.alias("s"), least.alias("least"))

        none = F.lit(None).cast("long")
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("held"), F.lit(0).cast("long").alias("s"), none.alias("least"))
        bits = lambda a: F.coalesce(F.lit(math.log2(width)) - a["least"] / (width * UNIT), F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, bits)

    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - FIRST)
    return F.when(F.length(s) >= width, bound(codes, best)).otherwise(F.lit(0.0))


def _suspicious(s: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.regexp_like(s, F.lit(pattern))
    limit = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(F.regexp_like(s, F.lit(pattern)), bits).otherwise(limit)
    return F.when(allowed, False).otherwise(window_entropy(s) >= limit)


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = F.col("text")
    # Lower bounds of length stand in the patterns where a run that falls short holds no longer one.
    d = d.select(
        "doc_id",
        located(t, ASSIGN, 0, lambda v: F.length(v) >= MIN_LENGTH["assign"], 1).alias("assign"),
        located(t, rf"AKIA[A-Z0-9]{{{MIN_LENGTH['access'] - 4},}}", 1).alias("access"),
        located(t, rf"[0-9a-f]{{{MIN_LENGTH['hex']},}}", 2).alias("hex"),
        located(t, CANDIDATE, 3, _suspicious).alias("entropy"),
    )
    d = d.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    clear = F.when(F.size("entropy") == 0, F.col("entropy")).otherwise(
        bound(F.col("entropy"), lambda e: bound(F.col("base"), lambda b: clear_of(e, b)))
    )
    d = d.withColumn("every", F.array_sort(F.concat("base", clear)))
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"),
    )


def oracle() -> str:
    """The same spans by joins, and windows counted one by one."""
    quote = lambda p: p.replace("'", "''")
    parts = []
    access, hexes = (rf"AKIA[A-Z0-9]{{{MIN_LENGTH['access'] - 4},}}", rf"[0-9a-f]{{{MIN_LENGTH['hex']},}}")
    for kind, (pattern, group) in enumerate([(ASSIGN, 1), (access, 0), (hexes, 0), (CANDIDATE, 0)]):
        p = quote(pattern)
        parts.append(
            f"select r, {kind} as kind, unnest(regexp_extract_all(text, '{p}', 0)) as m, unnest(regexp_extract_all(text, '{p}', {group})) as v, "
            f"unnest(string_split_regex(text, '{p}')[:-2]) as gap, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) as i from d"
        )
    limit = " ".join(f"when regexp_matches(v, '{p}') then {bits}" for p, bits in CLASSES[:-1])
    allow = " or ".join(f"regexp_matches(v, '{p}')" for p in ALLOW)
    name = f"[{', '.join(repr(k) for k in KINDS)}][kind + 1]"
    text = f"coalesce(string_agg({name} || ':' || s || ':' || e, ',' order by s, kind, e), '')"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
hits as ({' union all '.join(parts)}),
placed as (select *, sum(len(gap) + len(m)) over (partition by r, kind order by i)::bigint as e from hits),
spans as (select r, kind, v, e - len(m) as s, e from placed),
base as (select * from spans where kind in (1, 2) or (kind = 0 and len(v) >= {MIN_LENGTH['assign']})),
cand as (select * from spans where kind = 3 and not ({allow})),
free as (select * from cand c where not exists (select 1 from base b where b.r = c.r and b.s < c.e and c.s < b.e)),
bits as (select r, s, e, v, list_max(list_transform(range(1, len(v)::bigint - {WINDOW - 2}),
    lambda i: list_aggregate(string_split(substr(v, i, {WINDOW}), ''), 'entropy'))) as h from free),
found as (select r, 3 as kind, s, e from bits where h >= case {limit} else {CLASSES[-1][1]} end),
b as (select r, count_if(kind = 0)::bigint as n_assign, count_if(kind = 1)::bigint as n_access, count_if(kind = 2)::bigint as n_hex, {text} as base from base group by r),
a as (select r, {text} as spans from (select r, kind, s, e from base union all select * from found) group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join b using (r) left join a using (r)
"""
