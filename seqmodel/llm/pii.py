"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same for the same entity."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.ragged import slices
from seqmodel.sources.scratch import written

# What precedes a name, by gender.
TITLES = {
    "m": "Mr Mister Sir Herr Señor Sr Monsieur господин г-н κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Señora Sra Señorita Madame Mme Mademoiselle госпожа г-жа κυρία".split(),
    "n": "Dr Prof Professor Doctor Доктор".split(),
}
# Given names, to tell the gender of names without a title, and to draw surrogates from.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Peter Paul Hans Karl Pierre Jean Carlos José Juan Luis".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Anna Maria Julia Laura Claire Sophie Carmen Lucía Elena Ingrid".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Κατερίνα".split(),
}
_LETTERS = {
    "latin": ("aeiou", "bcdfghklmnprstvz"),
    "cyrillic": ("аеиоуыюя", "бвгдзклмнпрст"),
    "greek": ("αεηιοω", "βγδκλμνπρστ"),
}
_VOWELS = frozenset("aeiouyаеёиоуыэюяαεηιουω")

#: Rounds of proposals of which none was free, after which a plan of numbers counts as full.
IDLE_ROUNDS = 24

_GENDER = {t.casefold(): g for g, names in TITLES.items() for t in names}
_GIVEN = {n.casefold(): g for (_, g), names in GIVEN.items() for n in names}
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TITLED = re.compile(
    rf"\b(?P<title>{'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\b\.?[ \t]+(?P<names>{_NAME}(?:[ \t]+{_NAME}){{0,2}})"
)
_KNOWN = re.compile(rf"\b(?P<names>(?:{'|'.join(n for names in GIVEN.values() for n in names)})[ \t]+{_NAME})\b")
_ANY_TITLE = re.compile("|".join(sorted({*(t for ts in TITLES.values() for t in ts), *(n for ns in GIVEN.values() for n in ns)}, key=len, reverse=True)))
_POSSESSIVE = re.compile(r"['’][sS]$")
_WORD_BEFORE = re.compile(r"(?<!\w)([^\W\d_]+(?:['’-][^\W\d_]+)*)[ \t]+$")
_EMAIL_RIGHT = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_DIGIT = re.compile("[0-9]")
_GROUPED = re.compile(r"[0-9]{4}(?P<gap>[ \-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![0-9])")
_QUAD = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])")
# A number that begins with '+' only starts here: _international finds its end.
_NUMBERS = re.compile(
    r"(?<![0-9A-Za-z_])(?<![0-9]\.)(?:(?P<plus>\+(?=[0-9]))|(?:"
    r"(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9]))"
    rf"|(?P<ssn>{_SSN.pattern})"
    rf"|(?P<card>[0-9]{{13,19}}(?![0-9])|{_GROUPED.pattern})"
    r"|(?P<phone>(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|1?[2-9][0-9]{2}[2-9][0-9]{6}(?!\.?[0-9]))"
    r")(?![A-Za-z_]))"
)
_GROUP = re.compile(r"(?P<gap>[ .\-]?)(?:\((?P<inner>[0-9]{1,4})\)|(?P<plain>[0-9]+))")
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
# How many digits follow a country code, at least and at most.
PLANS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9),
    "36": (8, 9), "39": (8, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8),
    "48": (9, 9), "49": (7, 11), "51": (8, 9), "52": (10, 11), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10),
    "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10),
    "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10),
    "351": (9, 9), "353": (7, 9), "354": (7, 7), "359": (7, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9),
    "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
_LONGEST = 15
_LETTER = re.compile("[A-Za-z_]")
_RUN = re.compile(r"(?<![0-9A-Za-z_+])(?<![0-9]\.)[0-9]{8,15}(?![0-9A-Za-z_])(?!\.[0-9])")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    canon: str


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return next((s for s in ("cyrillic", "greek") if name.startswith(s.upper())), "latin")


def _of_local_part(c: str) -> bool:
    """Letters and digits of any script, with the accents that follow them, and the usual marks; never '@'."""
    return c.isalnum() or c in "._%+-" or unicodedata.category(c)[0] == "M"


def _national(digits: str) -> str:
    return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits


def _complete(digits: str) -> bool:
    """Whether ``digits`` are a country code and as many more as all numbers there have."""
    code = _CODE.match(digits)
    return code is not None and PLANS.get(code.group()) == (len(digits) - code.end(),) * 2


def _international(text: str, at: int) -> Entity | None:
    """The phone number at the '+' in place ``at``: as many groups as its country's plan has digits for, else 15 digits at most.

    It ends before a dotted quad, a card or a social security number that begins with a later group. A trunk '(0)' is
    not one of its digits.
    """
    ends: list[tuple[int, str]] = []
    digits, end, doubtful = "", at + 1, False
    while m := _GROUP.match(text, end):
        group = m.group("plain") or m.group("inner")
        start = m.start("plain") if m.group("plain") else m.start("inner")
        if digits:
            card = _GROUPED.match(text, start)
            other = (m.group("gap") != "." and _QUAD.match(text, start)) or _SSN.match(text, start)
            if (card and not _complete(digits + group) and not _luhn("".join(c for c in card.group() if c.isdigit()))) or (other and len(digits) > 3):
                break
            doubtful = doubtful or bool(other)
        elif m.group("gap"):
            break
        digits += "" if m.group("inner") == "0" else group
        if len(digits) > _LONGEST:
            break
        end = m.end()
        if not _LETTER.match(text, end):
            ends.append((end, digits))
    if (code := _CODE.match(digits)) is None:
        return None
    low, high = PLANS.get(code.group(), (_LONGEST, 0))
    fits = [e for e in ends if low <= len(e[1]) - code.end() <= high]
    if not fits and not doubtful:
        fits = [e for e in ends if len(e[1]) >= 8]
    if not fits:
        return None
    end, digits = fits[-1]
    return Entity(at, end, "phone", _national(digits) if code.group() == "1" and len(digits) == 11 else f"+{digits}")


def _numbers(text: str) -> Iterator[Entity]:
    at, phones = 0, set()
    while m := _NUMBERS.search(text, at):
        kind, at = m.lastgroup if m.lastgroup != "gap" else "card", m.end()
        if kind == "plus":
            e = _international(text, m.start())
        else:
            digits = m.group() if kind == "ip" else "".join(c for c in m.group() if c.isdigit())
            e = Entity(m.start(), m.end(), kind, _national(digits) if kind == "phone" else digits)
        if e:
            at = e.end
            if e.kind == "phone":
                phones.add(e.canon)
            yield e
    if phones:
        for m in _RUN.finditer(text):
            canon = f"+{m.group()}" if f"+{m.group()}" in phones else _national(m.group())
            if canon in phones:
                yield Entity(m.start(), m.end(), "phone", canon)


def entities(text: str | None) -> list[Entity]:
    """Emails, IPv4 addresses, phone, card and social security numbers, and names, by position and without overlap.

    Names are words in capitals after a title, or a known given name and the next word in capitals; their words are
    entities of their own, so the surname alone is the same entity as in the full name; a possessive 's is none of it.
    Once named, a surname counts wherever it stands in the text, in whatever case, and a named given name before it. So does a phone number, without separators too; alone it has to have the ten digits
    of a North American one then.
    """
    if not text:
        return []
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        start, right = at, _EMAIL_RIGHT.match(text, at + 1)
        while right and start and _of_local_part(text[start - 1]):
            start -= 1
        if start < at:
            found.append(Entity(start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += _numbers(text)
    if _ANY_TITLE.search(text):
        found += _names(text)
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _names(text: str) -> Iterator[Entity]:
    surnames: dict[str, str] = {}  # case-folded
    givens: dict[str, str] = {}
    for m in [*_TITLED.finditer(text), *_KNOWN.finditer(text)]:
        words = list(re.finditer(r"\S+", m.group("names")))
        gender = _GENDER.get((m.groupdict().get("title") or "").casefold(), "n")
        gender = gender if gender != "n" else _GIVEN.get(words[0].group().casefold(), "n")
        for no, w in enumerate(words):
            word, start = _POSSESSIVE.sub("", w.group()), m.start("names") + w.start()
            kind = f"family_{script_of(word)}" if no == len(words) - 1 else f"given_{gender}_{script_of(word)}"
            (surnames if kind.startswith("family") else givens)[word.casefold()] = kind
            yield Entity(start, start + len(word), kind, word.casefold())
    if surnames:
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(surnames, key=len, reverse=True))) + r")(?!\w)", re.IGNORECASE)
        for m in again.finditer(text):
            kind = surnames.get(m.group().casefold())
            if kind:
                yield Entity(m.start(), m.end(), kind, m.group().casefold())
                ahead = _WORD_BEFORE.search(text, max(0, m.start() - 64), m.start())
                if ahead and ahead.group(1).casefold() in givens:
                    yield Entity(ahead.start(1), ahead.end(1), givens[ahead.group(1).casefold()], ahead.group(1).casefold())


class _Draw:
    """Numbers from a key and what they are for."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.no, self.left = key, "\x1f".join(map(str, what)), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(f"{self.no}\x1f{self.what}".encode(), key=self.key, digest_size=64).digest()
            self.no += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _reshaped(text: str, draw: _Draw) -> str:
    """Every letter by one of its script and kind (vowel or not), every digit by a digit; the rest stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            script = script_of(c)
            if script == "latin" and not unicodedata.name(c, "").startswith("LATIN"):
                out.append(chr(ord(c) // 16 * 16 + draw.below(16)))
                continue
            base = unicodedata.normalize("NFD", c.lower())[0]
            letters = _LETTERS[script][0 if base in _VOWELS else 1]
            out.append(letters[draw.below(len(letters))])
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The ``attempt``-th proposal for an entity, in canonical form. An email's has its real domain: it is compared with
    the others of that domain, of which the surrogate belongs to no other.
    """
    draw = _Draw(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        return f"{_reshaped(_grown(local, attempt), draw)}@{domain}"
    if kind == "domain":
        return _reshaped(_grown(canon.rpartition(".")[0], attempt), draw) + ".example"
    if kind == "ip":
        return ".".join(str(x) for x in (1 + draw.below(223), draw.below(256), draw.below(256), draw.below(256)))
    if kind == "card":
        body = canon[0] + "".join(str(draw.below(10)) for _ in canon[1:])
        if _luhn(canon):
            return body
        return body[:-1] + str((10 - _luhn(body[:-1] + "0")) % 10)
    if kind == "phone":
        code = _CODE.match(canon, 1).group() if canon[0] == "+" else ""
        rest = canon.removeprefix("+")[len(code) :]
        dialled = len(rest) == 10 and rest[0] > "1" and rest[3] > "1"
        body = str(2 + draw.below(8)) + "".join(str(2 + draw.below(8) if dialled and i == 3 else draw.below(10)) for i in range(1, len(rest)))
        return ("+" if canon[0] == "+" else "") + code + body
    if kind == "ssn":
        return str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in canon[1:])
    if kind.startswith("given_"):
        _, gender, script = kind.split("_")
        names = GIVEN[script, gender] if gender != "n" else GIVEN[script, "m"] + GIVEN[script, "f"]
        return "-".join(names[draw.below(len(names))].casefold() for _ in range(1 + attempt))
    return _reshaped(_grown(canon, attempt), draw)


def _grown(name: str, letters: int) -> str:
    """``name`` with so many more letters of its script, so that there are ever more surrogates."""
    return name + "".join(_LETTERS[script_of(name)][i % 2][0] for i in range(letters))


def final_surrogate(kind: str, canon: str, attempts: dict[tuple[str, str], int], key: bytes) -> str:
    """The surrogate of an entity; an email has its domain's, which is an entity of its own."""
    new = surrogate(kind, canon, attempts.get((kind, canon), 0), key)
    if kind != "email":
        return new
    domain = canon.rpartition("@")[2]
    return new.rpartition("@")[0] + "@" + surrogate("domain", domain, attempts.get(("domain", domain), 0), key)


def rendered(kind: str, new: str, old: str) -> str:
    """``new`` in the form of the occurrence ``old``: its separators, country code and capitals."""
    if kind in ("phone", "card", "ssn"):
        digits, out = list(new.removeprefix("+")), []
        for i in range(len(old) - 1, -1, -1):
            trunk = i > 0 and old[i - 1 : i + 2] == "(0)"
            out.append(digits.pop() if old[i].isdigit() and not trunk and digits else old[i])
        return "".join(reversed(out))
    if kind == "ip":
        return new
    if len(old) > 1 and old.isupper():
        return new.upper()
    if kind == "email" or old.islower():
        return new
    return re.sub(r"[^\W\d_]+", lambda m: m.group().capitalize(), new)


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for e in found:
        new = final_surrogate(e.kind, e.canon, attempts, key)
        out += [text[at : e.start], rendered(e.kind, new, text[e.start : e.end])]
        at = e.end
    return "".join([*out, text[at:]]), len(found)


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]


def _distinct(found: list[Entity]) -> set[tuple[str, str]]:
    return {(e.kind, e.canon) for e in found} | {("domain", e.canon.rpartition("@")[2]) for e in found if e.kind == "email"}


def _occurring(df: DataFrame, text_col: str) -> DataFrame:
    """(__k1, __k2, kind, canon): the different entities of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = [
                    (a, b, kind, canon)
                    for a, b, text in zip(*[batch.column(c).to_pylist() for c in ("__k1", "__k2", text_col)], strict=True)
                    for kind, canon in _distinct(entities(text))
                ]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("__k1", "__k2", "kind", "canon"), zip(*rows, strict=True), strict=True)))

    return df.select(*_text_key(text_col), text_col).mapInArrow(run, "__k1 long, __k2 long, kind string, canon string")


def later_attempts(entities_: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first proposal is taken.

    A proposal is taken if it is a real entity of its kind, an earlier surrogate, or also that of a smaller entity. Those
    that are left propose again until none is left. Names, local parts and domains get longer with each attempt, so that
    ends; numbers keep their format, and where ``IDLE_ROUNDS`` in a row find no free one their plan is full: an error.
    ``entities_`` has distinct (kind, canon).
    """

    def propose(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(k, c, attempt, key) for k, c in zip(b.column("kind").to_pylist(), b.column("canon").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"kind": b.column("kind"), "canon": b.column("canon"), "new": new})

        return run

    real = entities_.select("kind", F.col("canon").alias("new"))
    left, taken, late, attempt, idle = entities_, None, None, 0, 0
    while True:
        proposed = left.select("kind", "canon").mapInArrow(propose(attempt), "kind string, canon string, new string")
        first = proposed.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        good = first.join(real, ["kind", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "new"), ["kind", "new"], "left_anti")
        good = written(good.select("kind", "canon", "new", F.lit(attempt).alias("attempt")), "surrogates")
        idle = idle + 1 if good.isEmpty() else 0
        taken = good if taken is None else written(taken.union(good), "surrogates")
        late = taken.where("attempt > 0")
        left = written(left.select("kind", "canon").join(good, ["kind", "canon"], "left_anti"), "surrogates-left")
        if left.isEmpty():
            return written(late.select("kind", "canon", "attempt"), "later-attempts", lookup=True)
        if idle == IDLE_ROUNDS:
            kinds = [r["kind"] for r in left.select("kind").distinct().collect()]
            raise ValueError(f"no free surrogates are left for entities of kind {', '.join(sorted(kinds))}")
        attempt += 1


def with_surrogates(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with every entity in ``text_col`` replaced; ``count_col`` gets the number of replaced spans.

    The surrogate of an entity depends on the key and the entity alone, so it is the same in every document. All
    different entities of the table are compared with all surrogates; only those whose first proposal is taken need
    an entry, and only texts that hold one of these get it joined. Null texts stay null, texts without entities
    stay as they are, equal rows stay equal, texts are taken whole however long; an empty table gives an empty table. A column named ``count_col``
    is replaced.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    seen = written(_occurring(df, text_col), "entities")
    late = later_attempts(seen.select("kind", "canon").distinct(), secret)
    columns = [c for c in df.columns if c != count_col]
    plain, attempts = df.select(*[F.col(f"`{c}`") for c in columns]), F.expr("cast(null as array<struct<kind:string,canon:string,attempt:int>>)")
    if late.isEmpty():
        rows = plain.withColumn("__attempts", attempts)
    else:
        own = seen.join(late, ["kind", "canon"]).groupBy("__k1", "__k2").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__attempts"))
        own = written(own, "attempts-of-texts", lookup=True)  # of one text each
        k1, k2 = _text_key(text_col)
        rows = plain.join(own, (k1 == own["__k1"]) & (k2 == own["__k2"]), "left").drop("__k1", "__k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                made = [
                    replaced(text, secret, {(a["kind"], a["canon"]): a["attempt"] for a in late_ or ()})
                    for text, late_ in zip(batch.column(text_col).to_pylist(), batch.column("__attempts").to_pylist(), strict=True)
                ]
                out = {c: batch.column(c) for c in columns} | {text_col: pa.array([t for t, _ in made], pa.string())}
                if count_col:
                    out[count_col] = pa.array([n for _, n in made], pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return rows.mapInArrow(run, kinds + (f", `{count_col}` long" if count_col else ""))
