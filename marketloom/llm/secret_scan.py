"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

All work is built-in functions over arrays of spans. Positions come from the pieces between matches
(``split`` by the same pattern), so they are code points, end exclusive.

Base patterns find assignments, access keys and long hex runs. The battery looks at every other run of
20 or more characters of a key's alphabet, but for those of small letters only or digits only: keys without
a digit are in mixed case or base32. Per inferred encoding (hex, base32,
base62, base64) it computes p-values of three tests of "a random string of this alphabet": chi-squared
uniformity (Wilson-Hilferty), runs above and below the alphabet's middle, and lag-one serial
correlation, joined by Bonferroni. Natural strings fail, random keys do not. How small a p-value must be
to dismiss a string is set per length class by Benjamini-Hochberg over all candidates of the corpus,
from a histogram (length class by p bin; a fixed number of rows), so that short strings, on which the
tests have little power, do not weaken the control of long ones.

Defined cases: a null or empty text has no spans; rows are judged one by one, so repeated rows and null
ids pass through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Kinds in their order; each has a pattern, the group that must be long enough, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a run is matched whole, so shorter runs cannot hide one
)
#: A run starts after anything outside the alphabet, '=' too, which is padding only at a run's end.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z]|[0-9+/_-]*[a-z][a-z+/_-]*[0-9]|[a-z+/_-]*[0-9][0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide: name, pattern of a whole string, alphabet in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: Lower bounds of the length classes, the false-discovery rate, and p bins per factor of 10 up to 10^-MOST.
LENGTHS, RATE, BINS, MOST = (20, 24, 32, 48, 80), 0.05, 8, 12
#: Matches of a text that are folded at once.
STRETCH = 256
_SPAN = "array<struct<start: int, kind_no: int, kind: string, end: int>>"


def _spans(text: str, pattern: str, group: int, least: int, kind_no: int, kind: str) -> str:
    """SQL for the spans of a pattern's matches, leftmost and non-overlapping, whose group is long enough."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    checked = f"regexp_extract_all({text}, {p}, {group})"
    # fold over (gap before, match): at is where the last match ended, o where a stretch of matches begins
    steps = (
        f"zip_with(regexp_extract_all({text}, {p}, 0), {checked}, (m, g) -> struct(char_length(m) as m, char_length(g) as g))"
    )
    fold = (
        f"aggregate(c, struct(o as at, cast(array() as {_SPAN}) as spans), "
        f"(s, x) -> struct(s.at + x.gap + x.m as at, if(x.g >= {least}, concat(s.spans, array(struct(s.at + x.gap as start, {kind_no} as kind_no, '{kind}' as kind, s.at + x.gap + x.m as end))), s.spans) as spans), "
        f"s -> s.spans)"
    )
    # stretches of matches are folded one by one, so that a text's spans are not copied for each match
    items = "zip_with(slice(gaps, 1, size(found)), found, (a, f) -> struct(char_length(a) as gap, f.m as m, f.g as g))"
    cut = f"transform(sequence(0, (size(items) - 1) div {STRETCH}), k -> slice(items, k * {STRETCH} + 1, {STRETCH}))"
    begun = "aggregate(transform(cs, c -> aggregate(c, 0, (s, x) -> s + x.gap + x.m)), struct(0 as at, cast(array() as array<int>) as o), (s, n) -> struct(s.at + n as at, concat(s.o, array(s.at)) as o), s -> s.o)"
    spans = f"flatten(zip_with(cs, {begun}, (c, o) -> {fold}))"
    fold = f"element_at(transform(array({items}), items -> element_at(transform(array({cut}), cs -> {spans}), 1)), 1)"
    # let found = steps and gaps = split(...)
    return (
        f"if({text} rlike {p}, element_at(transform(array({steps}), found -> element_at(transform(array(split({text}, {p}, -1)), gaps -> {fold}), 1)), 1), "
        f"cast(array() as {_SPAN}))"
    )


def _tested(token: str) -> str:
    """SQL for struct(n, p) of the battery on a string expression that is a lambda variable."""
    body = f"rtrim('=', {token})"
    alphabet = "case " + " ".join(f"when {token} rlike '{p}' then '{a}'" for _, p, a in ENCODINGS) + f" else '{ENCODINGS[-1][2]}-_+/' end"
    values = f"transform(split({body}, ''), ch -> cast(instr(al, ch) - 1 as double))"
    n = "cast(size(v) as double)"
    squares = "aggregate(array_distinct(v), 0D, (s, d) -> s + pow(size(filter(v, y -> y = d)), 2))"
    df = "(char_length(al) - 1D)"
    chi = f"((char_length(al) / {n}) * {squares} - {n})"
    z_chi = f"greatest(0D, (pow(greatest({chi}, 0D) / {df}, 1 / 3D) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})))"
    high = "size(filter(v, y -> y * 2 >= char_length(al)))"
    runs = "aggregate(v, struct(0D as r, -1 as b), (s, y) -> struct(s.r + if(s.b = if(y * 2 >= char_length(al), 1, 0), 0, 1) as r, if(y * 2 >= char_length(al), 1, 0) as b), s -> s.r)"
    expect = f"(2 * h * ({n} - h) / {n} + 1)"
    z_runs = f"if(h = 0 or h = {n}, sqrt({n}), abs({runs} - {expect}) / sqrt(greatest(({expect} - 1) * ({expect} - 2) / ({n} - 1), 0.25D)))"
    mean = f"(aggregate(v, 0D, (s, y) -> s + y) / {n})"
    serial = (
        f"aggregate(v, struct(0D as c, 0D as q, cast(null as double) as last), (s, y) -> struct(s.c + coalesce(s.last * (y - mu), 0D) as c, s.q + (y - mu) * (y - mu) as q, y - mu as last), "
        f"s -> if(s.q = 0, sqrt({n}), abs(s.c / s.q + 1 / {n}) * sqrt({n})))"
    )
    tail = lambda z, two: f"({two} / (1 + exp(least(1.5976D * ({z}) + 0.07056D * pow({z}, 3), 600D))))"  # noqa: E731  a logistic fit of the normal tail
    least = f"least({tail('zc', '1D')}, {tail('zr', '2D')}, {tail('zs', '2D')})"
    inner = f"element_at(transform(array({z_chi}), zc -> element_at(transform(array(element_at(transform(array(cast({high} as double)), h -> {z_runs}), 1)), zr -> element_at(transform(array(element_at(transform(array({mean}), mu -> {serial}), 1)), zs -> least(1D, 3 * {least})), 1)), 1)), 1)"
    with_values = f"element_at(transform(array({values}), v -> {inner}), 1)"
    return f"element_at(transform(array({alphabet}), al -> {with_values}), 1)"


def _bin(p: str) -> str:
    return f"cast(least({BINS * MOST}, floor(-log10(greatest({p}, 1e-300)) * {BINS})) as int)"


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base (spans in order) and spans (base and the battery's) for every row of ``docs`` (doc_id, text)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = ", ".join(_spans("t", pattern, group, least, i, kind) for i, (kind, pattern, group, least) in enumerate(BASE))
    found = text.select(
        "doc_id",
        F.expr(f"sort_array(concat({base}))").alias("base"),
        F.expr(_spans("t", CANDIDATE, 0, 20, len(BASE), "random")).alias("candidates"),
        "t",
    )
    clear = "filter(candidates, c -> not exists(base, b -> b.start < c.end and c.start < b.end))"
    length_class = "case " + " ".join(f"when c.end - c.start >= {n} then {i}" for i, n in reversed(list(enumerate(LENGTHS)))) + " else 0 end"
    tested = found.withColumn("candidates", F.expr(clear)).withColumn(
        "candidates",
        F.expr(
            f"transform(transform(candidates, c -> struct(c as span, {length_class} as class, substr(t, c.start + 1, c.end - c.start) as token)), "
            f"c -> struct(c.span as span, c.class as class, element_at(transform(array(c.token), tok -> {_bin(_tested('tok'))}), 1) as bin))"
        ),
    )
    kept = saved(tested.select("doc_id", "base", "candidates"), "spans")
    counts = kept.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").count().collect()  # at most classes times bins rows
    limit = dismissed_from({(r["class"], r["bin"]): r["count"] for r in counts}, rate)
    limits = "array(" + ", ".join(str(limit[i]) for i in range(len(LENGTHS))) + ")"
    return kept.select(
        "doc_id", "base", F.expr(f"sort_array(concat(base, transform(filter(candidates, c -> c.bin < element_at({limits}, c.class + 1)), c -> c.span)))").alias("spans")
    )


def dismissed_from(counts: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """Per length class the lowest p bin that Benjamini-Hochberg rejects; one beyond the last if none.

    Bin b holds p in (10^(-(b + 1) / BINS), 10^(-b / BINS)]; its upper edge stands for all of it.
    """
    out = []
    for c in range(len(LENGTHS)):
        total = sum(n for (k, _), n in counts.items() if k == c)
        first, seen = BINS * MOST + 1, 0
        for b in range(BINS * MOST, -1, -1):
            seen += counts.get((c, b), 0)
            if seen and 10 ** (-b / BINS) <= rate * seen / total:
                first = b
        out.append(first)
    return out


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    number = {f"n_{kind}": F.expr(f"cast(size(filter(base, s -> s.kind_no = {i})) as bigint)") for i, (kind, *_) in enumerate(BASE)}
    return scanned.select("doc_id", *[c.alias(n) for n, c in number.items()], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
