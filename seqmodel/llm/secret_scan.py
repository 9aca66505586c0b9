"""Secrets in whole texts: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns; a match counts from so many characters of the group on.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: The same matches as HEX once the short ones are dropped, but the others are not listed first.
_LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
_LONG_ACCESS = r"AKIA[A-Z0-9]{14,}+"

#: Runs of ``_LEAST`` characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"
_BLOCK = 256


@dataclass(frozen=True)
class CharacterClass:
    """Candidates that match ``pattern`` whole; hot windows have at least ``least`` bits a character."""

    name: str
    pattern: str
    alphabet: str
    window: int
    least: float


#: A candidate belongs to the first class it matches. Letters alone, or digits alone, are no candidates for a secret.
CLASSES = (
    CharacterClass("entropy_hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 20, 3.0),
    CharacterClass(
        "entropy_base64", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]+=*$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 20, 3.8,
    ),
)
#: Candidates that match one of these are no secrets: ids, content digests, placeholders. Base spans are not affected.
ALLOW_LIST = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:sha1|sha256|sha384|sha512|md5)-",
    r"(?i:example|placeholder|dummy|changeme|xxxx|0123456789|abcdefgh)",
)
#: Placeholders that stand as a path or name segment of their own: the rest of the candidate is judged without them.
SEGMENTS = r"(?<![^/_-])(?i:examples?|placeholders?|dummy|changeme|x{4,})(?![^/_-])"
_PARTS = rf"{SEGMENTS}|(?!{SEGMENTS})[A-Za-z0-9+=](?:(?!{SEGMENTS})[A-Za-z0-9+/_=-])*(?<![/_-])"
_LEAST = 20


def running_sums(values: Column) -> Column:
    """The sum of all earlier values for each one; in blocks, so that long arrays take linear time."""

    def fold(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")),
            lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        )

    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(_BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
    folded = F.transform(starts, lambda i: fold(F.slice(values, i, F.lit(_BLOCK))))
    joined = F.aggregate(
        folded,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<bigint>>)").alias("out")),
        lambda s, b: F.struct(
            (s["at"] + b["at"]).alias("at"), F.array_append(s["out"], F.transform(b["out"], lambda x: x + s["at"])).alias("out")
        ),
    )
    return F.flatten(joined["out"])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points.

    The pieces between the matches and the matches themselves tell all positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: (F.length(b) + F.length(h)).cast("long"))
    ends = F.zip_with(running_sums(sizes), sizes, lambda a, b: a + b)
    return F.zip_with(
        F.arrays_zip(ends.alias("end"), hits.alias("hit")), values,
        lambda e, v: F.struct((e["end"] - F.length(e["hit"])).alias("start"), e["end"].alias("end"), v.alias("value")),
    )


def _weight(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def hot_range(value: Column, kind: CharacterClass) -> Column:
    """(first, last) start of the windows of enough entropy in one candidate; null fields without any.

    H = log2 w - (sum of c log2 c) / w. The counts c and the sum follow the window: one character comes in and
    one goes out at each step.
    """
    letters = F.split(F.lower(value) if kind.alphabet.islower() or kind.name == "entropy_hex" else value, "")
    at = F.transform(letters, lambda x: F.instr(F.lit(kind.alphabet), x) - 1)
    w = kind.window

    def step(s: Column, i: Column) -> Column:
        come, go = F.get(s["at"], i), F.get(s["at"], i - w)
        n_come, n_go = F.get(s["counts"], come), F.get(s["counts"], go)
        counts = F.transform(
            s["counts"], lambda c, j: c + F.when(j == come, 1).otherwise(0) - F.when(j == go, 1).otherwise(0)
        )
        grown = s["sum"] + _weight(n_come + 1) - _weight(n_come)
        total = F.when(go.isNull(), grown).when(come == go, s["sum"]).otherwise(grown + _weight(n_go - 1) - _weight(n_go))
        hot = (i >= w - 1) & (F.log2(F.lit(float(w))) - total / w >= kind.least - 1e-9)
        return F.struct(
            s["at"].alias("at"), counts.alias("counts"), total.alias("sum"),
            F.when(hot & s["first"].isNull(), i - (w - 1)).otherwise(s["first"]).alias("first"),
            F.when(hot, i - (w - 1)).otherwise(s["last"]).alias("last"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(
        at.alias("at"), F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
        none.alias("first"), none.alias("last"),
    )
    folded = F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step)
    return F.struct(folded["first"].alias("first"), folded["last"].alias("last"))


def _hot_spans(m: Column, no: int, kind: CharacterClass) -> Column:
    hot = F.filter(F.array(hot_range(m["value"], kind)), lambda h: h["first"].isNotNull())
    return F.transform(
        hot,
        lambda h: F.struct(
            (m["start"] + h["first"]).alias("start"), F.lit(no).alias("kind"), (m["start"] + h["last"] + kind.window).alias("end")
        ),
    )


def _parts(m: Column) -> Column:
    """The match itself, or what lies between its placeholder segments; (start, end, value) in the text."""
    long = F.filter(matches(m["value"], _PARTS), lambda p: (F.length(p["value"]) >= _LEAST) & ~p["value"].rlike(rf"^{SEGMENTS}$"))
    moved = F.transform(
        long,
        lambda p: F.struct((m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["value"].alias("value")),
    )
    return F.when(m["value"].rlike(SEGMENTS), moved).otherwise(F.array(m))


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan_secrets(
    df: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow_list: tuple[str, ...] = ALLOW_LIST,
    text_col: str = "text",
) -> DataFrame:
    """``df`` with ``assign``, ``access``, ``hex`` and ``entropy``: arrays of (start, kind, end), sorted, in code points.

    ``kind`` numbers assign, access, hex, then the classes. Candidate strings are maximal runs of 20 or more of
    ``A-Za-z0-9+/_-``. Where a placeholder is a segment of its own (``/examples/``), the parts between such segments are
    candidates in its stead, so that a key behind it is found. A candidate that the allow list matches, or that is itself
    a base hex or access match, adds nothing. Others add the range from their first to their last hot window. Method spans
    may lie inside an assign span. All work is in the row: no shuffle, and null or empty texts, ties and repeated rows need no care. Columns
    named like the four new ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.expr(f"cast(array() as {_SPANS})")

    def base(no: int, pattern: str, group: int, least: int, gate: Column) -> Column:
        found = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end")))
        return F.when(gate, spans).otherwise(empty)

    def method() -> Column:
        found = F.filter(
            F.flatten(F.transform(matches(text, CANDIDATE), _parts)),
            lambda m: ~m["value"].rlike(r"^(?:[0-9a-f]{16,}|AKIA[A-Z0-9]{14,})$") & ~m["value"].rlike("|".join(f"(?:{a})" for a in allow_list) or "(?!)"),
        )

        def judged(m: Column) -> Column:
            out = empty
            for no, kind in reversed(list(enumerate(classes, len(BASE)))):
                out = F.when(m["value"].rlike(kind.pattern), _hot_spans(m, no, kind)).otherwise(out)
            return out

        return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(found, judged))).otherwise(empty)

    (a, b, c) = BASE
    return df.withColumns({
        "assign": base(0, ASSIGN, a[2], a[3], text.rlike(ASSIGN)),
        "access": base(1, _LONG_ACCESS, b[2], b[3], F.contains(text, F.lit("AKIA"))),
        "hex": base(2, _LONG_HEX, c[2], c[3], text.rlike(_LONG_HEX)),
        "entropy": method(),
    })


def joined(spans: Column, classes: tuple[CharacterClass, ...] = CLASSES) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(n) for n in [k for k, *_ in BASE] + [k.name for k in classes]])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy)`` of every row; no span gives an empty string."""
    found = scan_secrets(df.select(F.col(id_col), F.col(text_col)), text_col=text_col)
    base = F.concat("assign", "access", "hex")
    return found.select(
        F.col(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
