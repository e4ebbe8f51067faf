"""Secret scans in SQL functions only: three base patterns, and sliding-window entropy over candidate strings.

Positions: a pattern's matches and the pieces between them (regexp_extract_all and split walk the text alike, leftmost and
non-overlapping) give every match's code points by prefix sums. A prefix sum doubles its reach in each pass, so n matches
take n * log2(n) steps.

Candidates: maximal runs of `[A-Za-z0-9+/_=-]`, less the base spans and less the matches of the allow list (UUIDs,
placeholders, alphabets, digests of the empty string, one character eight times or more), which are cut out of a run
wherever they stand; what is left of it on either side is a candidate of its own if it has at least `WINDOW` characters.

Entropy: one walk over a candidate's character codes keeps the count of each code, packed into a few longs, and the sum of
n * log2(n) over the counts, scaled to whole numbers; a step adds the entering and removes the leaving character. A window's
Shannon entropy log2(w) - sum / w so costs one update and no recount. The threshold depends on the candidate's character
class: hexadecimal (either case), or mixed, which needs a letter; a candidate without a digit or of another class has none. The
hit is the stretch from the first to the last window above the threshold. Time is linear in a candidate's length.

Defined results: a null or empty text has no spans; repeated rows are scanned once each; an empty table gives no rows;
other columns are ignored. Where two spans start together, the kinds stand in the order assign, access, hex, entropy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
WINDOW, HEX_BITS, MIXED_BITS = 20, 3.0, 3.6
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more: its end is the same wherever it begins
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
CHARACTER = "[A-Za-z0-9+/_=-]"
#: {group} is the number of the group of one character.
ALLOWED = (
    r"(?i:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}"
    r"|example|placeholder|changeme|dummy|sample|your[_-]?(?:key|token|secret)|xxxxx|redacted|abcdefghij|0123456789|1234567890"
    r"|d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)"
    r"|({character})\{group}{{7,}}"
)
_SPANS = "array<struct<s:int,e:int>>"
#: Counts of one long, each of _BITS bits: counts go up to the window, which is at most 31 characters.
_BITS, _LONG, _FIRST, _CODES = 5, 12, ord("+"), ord("z") - ord("+") + 1
_SCALE = 1 << 32


def allowed(group: int) -> str:
    return ALLOWED.format(character=CHARACTER, group=group)


def pieces(window: int) -> str:
    """Matches of the allow list, or runs of `window` characters or more in which none begins. The look ahead keeps short
    words, most of a text, from being tried against the list."""
    return f"(?={CHARACTER}{{{window}}})(?:{allowed(1)}|(?:(?!{allowed(2)}){CHARACTER}){{{window},}}+)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefix_sums(values: str) -> str:
    """SQL: the running sums of an array of longs."""
    return f"""
    aggregate(
      sequence(0, CAST(ceil(log2(greatest(size({values}), 1))) AS INT)), {values},
      (acc, step) -> transform(acc, (x, i) -> x + IF(i >= shiftleft(1, step), acc[i - shiftleft(1, step)], 0L)))"""


def _places(pattern: str) -> Column:
    """SQL array of the (s, e, m) of the matches m of `pattern` in column text, in code points."""
    regex = _sql(pattern)
    found = f"""
    CASE WHEN text RLIKE {regex} THEN
      transform(array(named_struct('m', regexp_extract_all(text, {regex}, 0), 'gaps', split(text, {regex}, -1))), w ->
        transform(array(named_struct('m', w.m, 'ends', {_prefix_sums("transform(w.m, (x, i) -> CAST(length(w.gaps[i]) + length(x) AS BIGINT))")})), p ->
          transform(p.m, (x, i) -> named_struct('s', CAST(p.ends[i] AS INT) - length(x), 'e', CAST(p.ends[i] AS INT), 'm', x)))[0])[0]
    ELSE CAST(array() AS array<struct<s:int,e:int,m:string>>) END"""
    return F.expr(found)


def _spans(places: str, keep: str = "true") -> str:
    return f"transform(filter({places}, (x, i) -> {keep}), x -> named_struct('s', x.s, 'e', x.e))"


#: SQL: candidates as (s, e, codes): the runs less the base spans. Every border is an event; prefix sums of the events' marks,
#: a base span 2^32 and a run its number, tell what covers the stretch up to the next border.
_CUT = f"""
    transform(array(array_sort(concat(
        flatten(transform(runs, (r, i) -> array(named_struct('p', r.s, 'mark', CAST(i + 1 AS BIGINT)), named_struct('p', r.e, 'mark', CAST(-i - 1 AS BIGINT))))),
        flatten(transform(base, b -> array(named_struct('p', b.start, 'mark', 4294967296L), named_struct('p', b.end, 'mark', -4294967296L))))))), events ->
      transform(array(named_struct('events', events, 'cover', {_prefix_sums("transform(events, x -> x.mark)")})), w ->
        transform(
          filter(
            transform(w.events, (x, i) -> named_struct('s', x.p, 'e', IF(i + 1 < size(w.events), w.events[i + 1].p, x.p), 'run', w.cover[i])),
            x -> x.run > 0 AND x.run < 4294967296L AND x.e - x.s >= {{window}}),
          x -> named_struct('s', x.s, 'e', x.e, 'run', CAST(x.run - 1 AS INT))))[0])[0]"""


def _walk(window: int) -> str:
    """SQL: (first, last) start of the windows of candidate c, an array c.codes, above its class's threshold; -1 if there is none."""
    table = "array(" + ", ".join(f"{round(n * math.log2(n) * _SCALE) if n else 0}L" for n in range(window + 2)) + ")"
    limit = lambda bits: math.floor(window * (math.log2(window) - bits) * _SCALE)
    count = lambda code: f"CAST(shiftright(acc.n[{code} DIV {_LONG}], CAST({code} % {_LONG} * {_BITS} AS INT)) & 31L AS INT)"
    one = lambda code: f"shiftleft(1L, CAST({code} % {_LONG} * {_BITS} AS INT))"
    longs = -(-_CODES // _LONG)
    within = lambda a, b: f"x BETWEEN {ord(a) - _FIRST} AND {ord(b) - _FIRST}"
    digit = within("0", "9")
    # first the leaving character is taken off, then the entering one is added
    off = f"""
      IF(k < {window}, acc, named_struct('n', transform(acc.n, (x, i) -> IF(i = c.codes[k - {window}] DIV {_LONG}, x - {one(f"c.codes[k - {window}]")}, x)),
        'sum', acc.sum - c.f[{count(f"c.codes[k - {window}]")}] + c.f[{count(f"c.codes[k - {window}]")} - 1], 'first', acc.first, 'last', acc.last))"""
    on = f"""
      named_struct('n', transform(acc.n, (x, i) -> IF(i = c.codes[k] DIV {_LONG}, x + {one("c.codes[k]")}, x)),
        'sum', acc.sum - c.f[{count("c.codes[k]")}] + c.f[{count("c.codes[k]")} + 1], 'first', acc.first, 'last', acc.last)"""
    hit = f"k >= {window - 1} AND acc.sum <= c.most"
    return f"""
    transform(array(named_struct('codes', c.codes, 'f', {table}, 'most', CASE
        WHEN NOT exists(c.codes, x -> {digit}) THEN -1L
        WHEN forall(c.codes, x -> {digit} OR {within("a", "f")}) OR forall(c.codes, x -> {digit} OR {within("A", "F")}) THEN {limit(HEX_BITS)}L
        WHEN exists(c.codes, x -> {within("A", "Z")} OR {within("a", "z")}) THEN {limit(MIXED_BITS)}L
        ELSE -1L END)), c ->
      IF(c.most < 0, named_struct('first', -1, 'last', -1),
        aggregate(
          sequence(0, size(c.codes) - 1),
          named_struct('n', array_repeat(0L, {longs}), 'sum', 0L, 'first', -1, 'last', -1),
          (acc, k) -> transform(transform(array({off}), acc -> {on}), acc ->
            IF({hit}, named_struct('n', acc.n, 'sum', acc.sum, 'first', IF(acc.first < 0, k - {window - 1}, acc.first), 'last', k - {window - 1}), acc))[0],
          acc -> named_struct('first', acc.first, 'last', acc.last))))[0]"""


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, base, found): arrays of (start, rank, end) in code points; base of the three patterns, found by entropy."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", _places(ASSIGN).alias("assign"), _places(ACCESS).alias("access"), _places(HEX).alias("hex"), _places(pieces(window)).alias("runs"))
    keep = {"assign": f"length(regexp_extract(x.m, {_sql(ASSIGN)}, 2)) >= {ASSIGN_CHARS}"}
    ranked = ", ".join(f"transform({_spans(kind, keep.get(kind, 'true'))}, x -> named_struct('start', x.s, 'rank', {k}, 'end', x.e))" for k, kind in enumerate(KINDS[:3]))
    candidate = f"NOT x.m RLIKE {_sql(f'^(?:{allowed(1)})')} AND x.m RLIKE '[0-9]'"
    rows = rows.select("doc_id", "text", F.expr(f"array_sort(concat({ranked}))").alias("base"), F.expr(f"filter(runs, x -> {candidate})").alias("runs"))
    rows = rows.withColumn("cut", F.expr(f"IF(size(runs) = 0, CAST(array() AS array<struct<s:int,e:int,run:int>>), {_CUT.format(window=window)})"))
    codes = f"transform(runs, r -> transform(filter(split(r.m, ''), x -> x != ''), x -> ascii(x) - {_FIRST}))"
    found = f"""
    transform(array(named_struct('cut', cut, 'runs', IF(size(cut) = 0, CAST(array() AS array<int>), transform(runs, r -> r.s)), 'codes', IF(size(cut) = 0, CAST(array() AS array<array<int>>), {codes}))), w ->
      transform(
        filter(
          transform(
            transform(w.cut, x -> named_struct('s', x.s, 'codes', slice(w.codes[x.run], x.s - w.runs[x.run] + 1, x.e - x.s))),
            c -> named_struct('s', c.s, 'w', {_walk(window)})),
          r -> r.w.first >= 0),
        r -> named_struct('start', r.s + r.w.first, 'rank', 3, 'end', r.s + r.w.last + {window})))[0]"""
    return rows.select("doc_id", "text", "base", F.expr(found).alias("found"))


def rendered(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.rank], x.start, x.end)), ',')")
