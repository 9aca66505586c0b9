"""Spelling variants, packing and resampling against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqmodel.llm import pack, queries, resample, spelling

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, name, columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()


# spelling variants


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """One code point inserted, deleted or replaced, by the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(rows, how):
    counts = Counter()
    for no, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if no is None else no}:{run}".encode())
            if how.dropped and h % how.dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= how.least_length and n >= how.least_count}
    by_rest = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_rest[w[:i] + "\0" + w[i + 1 :]].add(w)
            by_rest[w[:i] + w[i + 1 :]].add(w)
        by_rest[w].add(w)
    around = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            around[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= how.ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return out


def forms_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_spelling_variants_of_the_documents(spark):
    got = forms_of(queries.op11_spelling_variants(spark, SF))
    want = plain_forms(table(spark, "documents", ["doc_id", "text"]), spelling.Variants(dropped=97))
    assert len(got) == len(set(got)) and set(got) == want and sum(r[1] is not None for r in want) > 20


def test_spelling_variants_of_odd_tables(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 8))) for _ in range(40)] + ["b" * 2100, "b" * 2099, "aaaaa", "aaaaaa"]
    texts = cases.odd_texts(rng) + ["ÉCOLE École école", "×÷×÷× ×÷×÷× ×÷×÷×", "naïvé 漢字abcde漢"]
    texts += [" ".join(rng.choice(stems) if rng.random() < 0.8 else rng.choice(stems)[1:] for _ in range(300)) for _ in range(8)]
    docs = cases.documents(spark, texts, ids=[None, *range(1, len(texts) - 1), 1])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for how in (spelling.Variants(), spelling.Variants(least_length=1, least_count=2, dropped=5, bits_per_word=1, filter_bytes=192)):
        got, want = forms_of(spelling.spelling_forms(docs, how)), plain_forms(rows, how)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert spelling.spelling_forms(cases.empty(spark)).count() == 0
    assert spelling.spelling_forms(cases.documents(spark, [None, "", "12 3"])).count() == 0


def test_each_near_pair_is_probed_from_one_side():
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    sizes = Counter(min(len(w), spelling.LONGEST_SHARD) for w in words)
    shards = spelling.Shards.of(sizes, 16)
    full = np.full((int(shards.blocks.sum()), spelling.BLOCK_WORDS), 2**64 - 1, np.uint64)
    held = spelling.Filter(shards, 0, len(full), full)
    whose, edits = spelling.likely_edits([w.encode() for w in words], np.frombuffer(b"abc", np.uint8), held)
    made = [(words[i], e.decode()) for i, e in zip(whose, edits, strict=True)]
    assert len(made) == len(set(made))
    known = set(words)
    real = {tuple(sorted(p)) for p in made if p[1] in known}
    assert len(real) == sum(e in known for _, e in made)
    assert real == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_a_pass_of_the_filter_misses_no_word():
    words = [f"w{i}x".encode() for i in range(3000)]
    shards = spelling.Shards.of(Counter(map(len, words)), 4)
    total = int(shards.blocks.sum())
    bits = np.zeros((total, spelling.BLOCK_WORDS), np.uint64)
    for _, codes in spelling._by_length(words):
        keys = spelling.word_keys(codes)
        spread = spelling.mix(keys ^ spelling._ODD)
        for k in range(spelling.KEY_BITS):
            word, bit = spelling._nth_bit(spread, k)
            np.bitwise_or.at(bits, (shards.block(codes.shape[1], keys), word), bit)
    found = 0
    for low in range(0, total, 7):
        held = spelling.Filter(shards, low, min(low + 7, total), bits[low : low + 7])
        found += sum(len(held.may_hold(codes.shape[1], spelling.word_keys(codes))) for _, codes in spelling._by_length(words))
    assert found == len(words)


# packing


def check_packing(rows, texts, how):
    """The rows are a packing of the texts without padding: every id once, every sequence full or a power of two."""
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for no, text in texts:
        want[(no, np.array([*library.encode(text or "", add_special_tokens=False).ids, how.end_id], "<u4").tobytes())] += 1
    per_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert 0 < r.length == len(r.ids) // 4
        per_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.length, bytes(r.ids)))
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == how.size or (at < how.size and at & (at - 1) == 0)
    if all(n == 1 for n in Counter(no for no, _ in texts).values()):
        got = Counter()
        for (no, tokens), parts in pieces.items():
            at, ids = 0, b""
            for start, length, piece in sorted(parts):
                assert start == at
                at, ids = at + length, ids + piece
            assert at == tokens
            got[(no, ids)] += 1
        assert got == want
    else:
        assert Counter(i for r in rows for i in np.frombuffer(r.ids, "<u4")) == Counter(i for (_, ids), n in want.items() for i in np.frombuffer(ids * n, "<u4"))
    return per_sequence


def test_ids_of_columns_match_the_library(monkeypatch):
    """Whatever the blocks and what is remembered; contractions, runs of blanks, odd letters and special strings, too."""
    rng = random.Random(8)
    signs = "aab'' \n\t.s,trevmld9é?-’×ʯʰꙀ\r 1  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += ["x" * 200, "-" * 300 + " " + "-" * 301, " " * 500, "<|endoftext|>", "a<|endoftext|>b 's", "a<|endof", "text|>", None, "", "é" * 70]
    texts += ["it's they're I'll 'sun ''s !'s \n's  's '", "s've", "ab " * 3000, "", "'", "l", "l"]
    library = Tokenizer.from_file(VOCABULARY)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    known = pack.TokenIds(VOCABULARY)
    assert known.of_column(pa.array(texts)) == want == known.of_column(pa.array(["-", *texts])[1:])
    monkeypatch.setattr(pack, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(pack, "REMEMBERED", 500)
    known = pack.TokenIds(VOCABULARY)
    for _ in range(2):
        assert known.of_column(pa.array(texts)) == want
    assert known.of_column(pa.array([], pa.string())) == [] and known.of_column(pa.array([None], pa.string())) == [b""]


def test_plain_texts_are_put_together_as_arrays(monkeypatch):
    """No text of usual letters is cut by a pattern of its own, which took most of the time."""
    known = pack.TokenIds(VOCABULARY)
    monkeypatch.setattr(known, "of", lambda texts: pytest.fail(f"one by one: {texts}"))
    assert len(known.of_column(pa.array(["It's an été of 1999,\r\n\tisn't it?  Yes."] * 3))[0]) > 0


def test_packing_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    how = pack.Packing()
    rows = pack.packed(docs, VOCABULARY, how).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check_packing(rows, texts, how)
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= tokens // how.size + how.size.bit_length()
    digests = {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in queries.op12_packing(spark, SF).collect()}
    assert digests == {(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in rows}


@pytest.mark.parametrize("size", [1, 16, 64, 2048])
def test_packing_of_odd_tables(spark, size):
    rng = random.Random(size)
    texts = cases.odd_texts(rng) + ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "it's  \n\n we'll\t ''s", "\x00 \x85   ½"]
    texts += [cases.words(rng, rng.randrange(30)) for _ in range(60)]
    how = pack.Packing(size=size)
    docs = cases.documents(spark, texts).repartition(3)
    check_packing(pack.packed(docs, VOCABULARY, how).collect(), list(enumerate(texts)), how)
    ids = [None, None, *[1] * (len(texts) - 2)]
    check_packing(pack.packed(cases.documents(spark, texts, ids=ids), VOCABULARY, how).collect(), list(zip(ids, texts, strict=True)), how)
    assert pack.packed(cases.empty(spark), VOCABULARY, how).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(3)
    for size, spread in ((16, 40), (256, 300), (2048, 5000)):
        counts = np.zeros(size + 1, np.int64)
        lengths = np.minimum(rng.geometric(6 / size, spread), size)
        np.add.at(counts, lengths, 1)
        counts[size // 3] += spread  # one length holds a large part
        plan = pack.Plan.of(counts, pack.Packing(size=size))
        filled, cuts = Counter(), 0
        for n in np.flatnonzero(counts).tolist():
            ranks = np.arange(plan.placed[n])
            at = plan.placed_at(np.full(len(ranks), n), ranks)
            for q, o in zip(*(a.tolist() for a in at), strict=True):
                filled.update((q, o + i) for i in range(n))
            for rank in range(int(plan.placed[n]), int(counts[n])):
                parts = plan.cut(n, rank)
                assert sum(p[1] for p in parts) == n
                cuts += len(parts) - 1
                for _, length, q, o in parts:
                    filled.update((q, o + i) for i in range(length))
        assert set(filled.values()) == {1} and len(filled) == (counts * np.arange(size + 1)).sum()
        assert cuts < 0.5 * (len(filled) // size)  # laid end to end, nearly every window would cut a piece


def test_least_squares_solution_is_optimal():
    """No combination's use could be raised or, if it is used, lowered to come nearer to the histogram."""
    counts = np.zeros(17, np.int64)
    counts[[3, 4, 5, 7, 9, 12, 13]] = [40, 25, 30, 12, 11, 18, 33]
    how = pack.Packing(size=16, rounds=4000)
    lengths, times = pack.combinations(counts, how)
    assert ((lengths * times).sum(1) == 16).all() and len({(tuple(a), tuple(b)) for a, b in zip(lengths, times, strict=True)}) == len(lengths)
    x = pack.repeats(lengths, times, counts, how)
    used = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), 17)
    slope = (times * (used - counts)[lengths]).sum(1)
    assert (x >= 0).all() and (slope > -1e-3).all() and (np.abs(slope[x > 1e-3]) < 1e-2).all()


# resampling


def plain_resampling(docs, target, how):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % how.buckets for n in range(1, how.longest + 1) for i in range(len(words) - n + 1)]

    rows = [(no, *found(text)) for no, text in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in found(x)[1])
    total_s, total_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + how.buckets) / ((s[b] + 1) * (total_t + how.buckets)))) for b in s}
    out = []
    for no, words, buckets in rows:
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(sha256(f"{how.seed}:{'' if no is None else no}".encode()).hexdigest()[:8], 16)
        out.append([no, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    long_ones = sorted((r for r in out if r[5] >= how.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(long_ones[: how.num * len(long_ones) // how.den]):
        r[4] = rank + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_of_the_documents(spark):
    want = plain_resampling(table(spark, "documents", ["doc_id", "text"]), [r.text for r in table(spark, "benchmark", ["text"])], resample.Resampling())
    got = queries.op13_target_resampling(spark, SF)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 5
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == want
    assert sum(r[4] is not None for r in want) > 10


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_resampling_of_odd_tables(spark, longest):
    rng = random.Random(longest)
    texts = cases.odd_texts(rng) + ["a\x00b\x00", "\x00", "É ß 漢字 x_y 1-2", "one"] + [cases.words(rng, rng.randrange(60), 50) for _ in range(150)]
    ids = [None, None, *range(2, len(texts) - 1), 2]
    docs = cases.documents(spark, texts, ids=ids).repartition(3)
    target = [None, "", "w1x w2x w3x", texts[-1]]
    for how in (resample.Resampling(longest=longest, buckets=97, num=50), resample.Resampling(longest=longest, buckets=70_000, num=100, least_words=0)):
        got = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), how)
        got = Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()))
        assert got == plain_resampling(list(zip(ids, texts, strict=True)), target, how)
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(cases.empty(spark), none).count() == 0
    assert resample.resampled(docs, none, resample.Resampling(longest=longest)).count() == len(texts)
