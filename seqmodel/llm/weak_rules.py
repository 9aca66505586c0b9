"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.ragged import map_texts
from seqmodel.sources.scratch import written

# Fixed values of the base counts: the symbols, and the words of a repeated window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_BLANKS = b" \t\n\r\x0b\x0c"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_upper_words long, n_same_next long, n_distinct_words long, n_stops long"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in some window of ``window`` words which the text holds twice or more.

    Windows get exact numbers by doubling: pairs of numbered halves are numbered again.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    span, at = 1, np.asarray(ids, np.int64)
    while span < window:
        at = at[: len(at) - span] * (int(at.max()) + 1) + at[span:]
        span *= 2
        if span < window:
            at = np.unique(at, return_inverse=True)[1]
    _, inverse, count = np.unique(at, return_inverse=True, return_counts=True)
    first = np.flatnonzero(count[inverse] > 1)
    if not len(first):
        return 0
    step = np.diff(first, append=first[-1] + window)
    return int(np.minimum(step, window).sum())


def text_counts(text: str | None, stop_words: frozenset[bytes]) -> tuple[int, ...]:
    """The base counts and those the further rules look at. Null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    kinds = list(numbers)
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in kinds), bool, len(kinds))
    stops = np.fromiter((w.lower().strip(b".,;:!?") in stop_words for w in kinds), bool, len(kinds))
    return (
        len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), int(upper[ids].sum()), int((ids[1:] == ids[:-1]).sum()), len(kinds), int(stops[ids].sum()),
    )


#: Frequent small words of the corpus languages; a rule reads their share.
STOP_WORDS = frozenset(
    w.encode()
    for w in "the of and to in a is that for it as was with by on are be this from or an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans au sur se ce pas "
    "el los las del que por con una su para como al lo más y es".split()
)


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) where ``good`` holds, 0 (bad) where ``bad`` does, else abstains (null)."""

    name: str
    bad: str
    good: str


#: SQL conditions over the counts; "false" never votes that way. What both or neither condition covers abstains.
#: A rule that looks for one kind of damage says nothing about a text without it; the last three look at the
#: whole and vouch for a text only where none of the frequent kinds of damage shows.
RULES = (
    Rule("symbols", "n_symbols > 0.15 * n_words", "false"),
    Rule("upper", "n_upper_words > 0.3 * n_words", "false"),
    Rule("repeats", "n_repeat_words > 0.25 * n_words", "false"),
    Rule("same_next", "n_same_next > 0.1 * n_words", "false"),
    Rule("dup_lines", "n_dup_lines > 0.5 * n_lines", "false"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "false"),
    Rule("calm", "n_symbols + n_upper_words > 0.5 * n_words", "n_symbols + n_upper_words <= 0.05 * n_words and n_same_next <= 0.03 * n_words"),
    Rule("stops", "n_stops < 0.01 * n_words", "n_stops between 0.06 * n_words and 0.7 * n_words and n_symbols + n_upper_words <= 0.1 * n_words and n_same_next <= 0.03 * n_words"),
    Rule("variety", "n_distinct_words < 0.05 * n_words", "n_distinct_words > 0.3 * n_words and n_repeat_words <= 0.1 * n_words and n_symbols + n_upper_words <= 0.1 * n_words"),
)


def votes(rules: tuple[Rule, ...]) -> list:
    return [
        F.when(F.expr(f"({r.bad}) and not ({r.good})"), 0).when(F.expr(f"({r.good}) and not ({r.bad})"), 1).alias(f"vote_{r.name}")
        for r in rules
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85) -> np.ndarray:
    """Posterior probability of good for each vote pattern (-1: abstained), by expectation-maximisation.

    Each rule has, for either class, its own chances of voting good, voting bad and abstaining. The start is
    the majority of the votes; Dirichlet pseudo-counts that favour right votes keep the classes from changing
    places. Patterns without any vote get the class share.
    """
    if not len(patterns):
        return np.zeros(0)
    weight = counts / counts.sum() * min(counts.sum(), 1e9)
    good, bad = patterns == 1, patterns == 0
    hot = np.stack([bad, good, patterns == -1], 2).astype(float)  # pattern, rule, vote
    pseudo = np.array([[4.0, 1.0, 1.0], [1.0, 4.0, 1.0]])  # class, vote
    cast = good.sum(1) + bad.sum(1)
    posterior = (good.sum(1) + prior) / (cast + 1)
    posterior = np.where(bad.sum(1) >= 1, np.minimum(posterior, 0.5), posterior)
    for _ in range(rounds):
        share = (weight @ posterior + 8.5 * prior) / (weight.sum() + 8.5)
        log = []
        for c, p in ((0, 1 - posterior), (1, posterior)):
            seen = np.einsum("p,prv->rv", weight * p, hot) + pseudo[c]
            chance = np.log(seen / seen.sum(1, keepdims=True))
            log.append(np.einsum("prv,rv->p", hot[:, :, :2], chance[:, :2]))  # an abstention says nothing
        odds = log[1] - log[0] + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return posterior


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, votes, ``posterior`` (of good) and ``kept`` of every row.

    One pass counts words and lines of the whole texts; the votes of all rows are counted by pattern, at most
    3 to the power of the rules rows however large the table, and only these reach the driver for EM. A row is
    kept if the base did not fail it and its posterior is at least ``least``. Null and empty texts have no words
    and fail the base. Repeated or null ids give one row each; an empty table gives an empty table; other
    columns are not read.
    """

    def counted(batch: pa.RecordBatch) -> dict:
        rows = [text_counts(t, STOP_WORDS) for t in batch.column(text_col).to_pylist()]
        names = [x.split()[0] for x in f"{COUNTS}, {MORE}".split(", ")]
        return dict(zip(names, np.array(rows, np.int64).T, strict=True))

    kind = df.schema[id_col].dataType.simpleString()
    counts = map_texts(df, [id_col], text_col, counted, f"`{id_col}` {kind}, {COUNTS}, {MORE}")
    seen = written(counts.select("*", *votes(rules)), "rule-votes")
    names = [f"vote_{r.name}" for r in rules]
    pattern = F.concat(*[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    tally = seen.groupBy(pattern.alias("pattern")).count().collect()  # 3 ** len(rules) rows at most
    codes = {"0": 0, "1": 1, "-": -1}
    rows = np.array([[codes[c] for c in r["pattern"]] for r in tally], int).reshape(len(tally), len(rules))
    posterior = fit(rows, np.array([r["count"] for r in tally], float))
    table = df.sparkSession.createDataFrame(
        [(r["pattern"], float(p)) for r, p in zip(tally, posterior, strict=True)], "pattern string, posterior double"
    )
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return (
        seen.withColumn("pattern", pattern)
        .join(F.broadcast(table), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= least))
        .drop("pattern")
    )
