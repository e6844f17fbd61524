"""Secret scan [native].

Base kinds are patterns (assign, access, hex). The method adds kind ``entropy``. Candidate strings are the runs of at
least WINDOW token characters in what is left of a text when its assign, access and hex matches (in this order) and
allow-listed pieces are blanked out; so a run loses what is known and the rest of it is judged for itself. A candidate
is classed by its characters, a window of WINDOW characters slides over it, and the window's Shannon entropy follows
from the counts of the character that enters and the one that leaves. Candidates whose highest window entropy
reaches the limit of their class are spans, unless they are slugs (words and numbers joined by one kind of sign or another).

Everything is Spark SQL expressions within a row. A window's counts are packed, twelve to a long; entropies are
compared as whole numbers, so nothing drifts; positions are running sums by doubling. The work grows with the length of
the text (the logarithm of its matches apart), also within one long token.

Nulls: a null text is the empty text and has no spans. Long texts are scanned whole. Repeated rows come out as often as
they come in; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 20
#: The patterns of the contract, with letters in either case written out.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
VALUE_CHARS, MIN_VALUE = "A-Za-z0-9+/_.=-", 8
#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Class -> (pattern of the whole candidate, entropy limit in bits), tried in this order. Letters alone and digits alone
#: are words and numbers whatever their entropy.
CLASSES = {"letters": (r"^[A-Za-z_=/-]*$", None), "digits": (r"^[0-9+/_=-]*$", None), "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), "token": (r"^[A-Za-z0-9]+$", 3.5), "base64": (r"^", 3.75)}
#: Pieces that are no secrets: identifiers with a fixed shape, placeholders, runs of the alphabet, one repeated character.
ALLOWED = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|PLACEHOLDER|[Cc]hangeme|[Xx]{6,}|0123456789|1234567890|abcdefgh|ABCDEFGH"
#: Whole candidates that are no secrets: at least four words or numbers; a part of letters and digits mixed is none.
SLUG = r"^([a-z]+|[0-9]+)([-_/]([a-z]+|[0-9]+)){3,}$"
FIRST_CHAR, PACKED, COUNT_BITS = ord("+"), 12, 5
WORDS = (ord("z") - FIRST_CHAR) // PACKED + 1
UNIT = 1 << 40
#: Doublings of a running sum: a string of 2 GB holds fewer matches than 2 ** ROUNDS.
ROUNDS = 27
SPANS = "array<struct<start:int,end:int,found:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(numbers: str) -> str:
    """SQL: the running sums of an array, by doubling."""
    return f"aggregate(sequence(0, {ROUNDS - 1}), {numbers}, (a, r) -> if(size(a) <= shiftleft(1, r), a, transform(a, (x, i) -> x + if(i < shiftleft(1, r), 0, a[greatest(i - shiftleft(1, r), 0)]))))"


def _starts(text: str, pattern: str) -> str:
    """SQL: array of (start, end, found) of the leftmost non-overlapping matches, in code points."""
    p = _quoted(pattern)
    lengths = "zip_with(f, q, (x, y) -> char_length(y) + char_length(x))"
    # there is one more piece than matches
    spans = f"zip_with({_running(lengths)}, f, (e, x) -> named_struct('start', e - char_length(x), 'end', e, 'found', x))"
    spans = _let(f"slice(split({text}, {p}, -1), 1, size(f))", "q", spans)
    return f"if({text} rlike {p}, {_let(f'regexp_extract_all({text}, {p}, 0)', 'f', spans)}, cast(array() as {SPANS}))"


def _blanked(text: str, pattern: str, where: str = "true") -> str:
    """SQL: ``text`` with the matches f that fulfil ``where`` replaced by as many blanks."""
    p = _quoted(pattern)
    pieces = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (q, f) -> concat(q, coalesce(if({where}, repeat(' ', char_length(f)), f), '')))"
    return f"if({text} rlike {p}, array_join({pieces}, ''), {text})"


def _weight(n: int) -> int:
    """n * log2(n) as a whole number of 1 / UNIT."""
    return round(n * math.log2(n) * UNIT) if n else 0


def _lightest(candidate: str) -> str:
    """SQL: the least sum of weights of the counts of a window's characters; the entropy is log2(WINDOW) less WINDOW-th of it."""
    rise = "array(" + ", ".join(f"{_weight(n + 1) - _weight(n)}L" for n in range(WINDOW)) + ")"
    chars = f"transform(filter(split({candidate}, ''), c -> c <> ''), c -> ascii(c) - {FIRST_CHAR})"
    places = f"transform({chars}, c -> named_struct('word', c div {PACKED}, 'shift', cast({COUNT_BITS} * (c % {PACKED}) as int)))"
    moves = f"transform(k, (x, i) -> named_struct('i', i, 'in', x, 'out', if(i < {WINDOW}, named_struct('word', -1L, 'shift', 0), k[greatest(i - {WINDOW}, 0)])))"
    held = lambda side: f"cast(shiftright(a.n[greatest(m.{side}.word, 0)], m.{side}.shift) & {(1 << COUNT_BITS) - 1} as int)"
    s = f"if(m.in = m.out, a.s, a.s + {rise}[{held('in')}] - if(m.out.word < 0, 0L, {rise}[greatest({held('out')} - 1, 0)]))"
    n = "transform(a.n, (v, j) -> v + if(j = m.in.word, shiftleft(1L, m.in.shift), 0L) - if(j = m.out.word, shiftleft(1L, m.out.shift), 0L))"
    step = f"named_struct('n', {n}, 's', {s}, 'least', if(m.i < {WINDOW - 1}, a.least, least(a.least, {s})))"
    return _let(places, "k", f"aggregate({moves}, named_struct('n', array_repeat(0L, {WORDS}), 's', 0L, 'least', {_weight(WINDOW)}L), (a, m) -> {step}, a -> a.least)")


def _suspicious(found: str) -> str:
    most = lambda limit: math.floor((math.log2(WINDOW) - limit) * WINDOW * UNIT)
    cases = " ".join(f"when {found} rlike {_quoted(p)} then {'-1L' if limit is None else f'{most(limit)}L'}" for p, limit in CLASSES.values())
    return f"not {found} rlike {_quoted(SLUG)} and {_let(f'case {cases} end', 'most', f'most >= 0 and {_lightest(found)} <= most')}"


def scan(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """keep..., and found: array of (start, end, rank, kind) of all spans, sorted by start and kind."""
    spans = lambda column, kind: F.expr(f"transform({column}, x -> named_struct('start', x.start, 'rank', {KINDS.index(kind)}, 'end', x.end, 'kind', '{kind}'))")
    # group 2 is what follows the sign, as its characters are all that may follow
    value = _quoted(rf"^.*?[:=]\x20*[\"']?([{VALUE_CHARS}]+)$")
    long_enough = lambda f: f"char_length(regexp_extract({f}, {value}, 1)) >= {MIN_VALUE}"
    base = (
        docs.select(*keep, text_of(text).alias("_t"))
        .withColumn("_assign", F.expr(f"filter({_starts('_t', ASSIGN)}, x -> {long_enough('x.found')})"))
        .withColumn("_access", F.expr(_starts("_t", ACCESS)))
        .withColumn("_hex", F.expr(_starts("_t", HEX)))
        .withColumn("_base", F.concat(spans("_assign", "assign"), spans("_access", "access"), spans("_hex", "hex")))
        .withColumn("_left", F.expr(_blanked("_t", ASSIGN, long_enough("f"))))
    )
    for pattern in (ACCESS, HEX, ALLOWED):
        base = base.withColumn("_left", F.expr(_blanked("_left", pattern)))
    return base.withColumn("_entropy", F.expr(f"filter({_starts('_left', CANDIDATE)}, x -> {_suspicious('x.found')})")).select(
        *keep, F.sort_array(F.concat("_base", spans("_entropy", "entropy"))).alias("found")
    )


def _joined(array: str) -> Column:
    return F.expr(f"array_join(transform({array}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id")
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    base = found.withColumn("base", F.expr("filter(found, x -> x.kind <> 'entropy')"))
    return base.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("found").alias("spans"))
