"""Leaks, urls, mixing, copies, surrogates and revisits against plain Python; the pipeline stage by stage."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from compare import difference, oracle
from pyspark.sql import functions as F

import corpus_pipeline
from seqmodel.llm import decontaminate, mixing, parity_join, pii, qda, queries, ragged, revisits, url_filter
from seqmodel.llm.components import components

SF = "/root/testdata/sf0.001"


# benchmark decontamination


def shingled(text, size=5):
    w = [x for x in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    items = [cases.words(rng, n, 900) for n in (4, 5, 9, 16, 16, 30, 60, 60, 120)] + [None, "", "!!"]
    texts = cases.odd_texts(rng) + [items[0], items[0] + " more"]
    for item in items[1:9]:
        w = item.split()
        for share in (1.0, 0.9, 0.8, 0.5):
            texts.append(cases.words(rng, rng.randrange(400)) + ". " + " ".join(w[: round(share * len(w))]).upper() + "! " + cases.words(rng, rng.randrange(3000)))
    texts += ["\n".join(items[1:9]), "\n".join(items[1:9]) * 2]  # far more shared shingles than any item has
    how = decontaminate.Containment(most_hashes=40)
    docs = cases.documents(spark, texts, ids=[None, *range(1, len(texts))])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(docs, bench, how).collect())
    want = Counter()
    for i, t in enumerate(texts):
        s = shingled(t)
        for j, item in enumerate(items):
            q = shingled(item)
            if q and 100 * len(s & q) >= 80 * len(q):
                want[(i or None, j, len(s & q), len(q))] += 1
    assert got == want and len(want) > 30
    clean = decontaminate.without_leaks(docs, bench, how)
    assert clean.columns == docs.columns and clean.count() == len(texts) - len({w[0] for w in want})
    for a, b in ((cases.empty(spark), bench), (docs, bench.limit(0)), (docs, bench.where("text is null or text = ''"))):
        assert decontaminate.leaks(a, b).count() == 0


def test_texts_are_cut_into_words_once(spark):
    """The pattern stood in a filter and both branches of a case as well, so each text was cut up to four times."""
    texts = [None, "", " \n", "!!", "--One--", " a  b ", "É-ß 漢字, x_y 7"]
    docs = cases.documents(spark, texts)
    rows = docs.select("doc_id", decontaminate.words_of(F.col("text")).alias("w")).orderBy("doc_id").collect()
    assert [r.w for r in rows] == [[], [], [], [], ["one"], ["a", "b"], ["é", "ß", "漢字", "x", "y", "7"]]
    found = decontaminate._shingles(docs, ["doc_id"], "text", 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1
    assert Counter(r.doc_id for r in found.collect()) == {4: 1, 5: 1, 6: 2}


def test_small_slices_hold_all_texts_and_little_at_once():
    """Workers that wait kept what 4 MB of text took in quality and near_duplicates."""
    rng = random.Random(12)
    texts = [None, "", *(cases.words(rng, 400) for _ in range(1500)), "a" * 3_000_000]
    batch = pa.RecordBatch.from_pydict({"id": np.arange(len(texts)), "text": texts})
    parts = list(ragged.slices(batch, "text", ragged.SMALL_SLICE_BYTES))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sizes = [sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts]
    assert sum(sizes) > 6 * ragged.SMALL_SLICE_BYTES and max(sizes[:-1]) < 1.01 * ragged.SMALL_SLICE_BYTES
    tracemalloc.start()
    several = [qda.statistics(p, "text") for p in parts[:-1]]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 60 << 20
    whole = qda.statistics(batch.slice(0, sum(p.num_rows for p in parts[:-1])), "text")
    assert np.array_equal(np.concatenate(several), whole)


@pytest.mark.parametrize("work", ["quality", "near_duplicates"])
def test_statistics_and_shingles_are_worked_on_in_small_slices(spark, work, monkeypatch):
    taken = []
    mapped = ragged.map_texts

    def noted(df, keep, text, fn, schema, most=ragged.SLICE_BYTES):
        taken.append(most)
        return mapped(df, keep, text, fn, schema, most)

    monkeypatch.setattr(qda if work == "quality" else parity_join, "map_texts", noted)
    docs = cases.documents(spark, ["a b c d e f", "x"])
    if work == "quality":
        qda._stats(docs, "doc_id", "text")
    else:
        parity_join._sets(docs.withColumn("id", F.col("doc_id")), parity_join.Similarity())
    assert taken == [ragged.SMALL_SLICE_BYTES]


def test_hash_functions_suffice_for_every_pair_of_sizes():
    how = decontaminate.Containment()
    for p, row in how.plan().items():
        for q, b in row.items():
            n, u = 2**q, 2 ** (p + 1) - 1  # the least alike pair of these classes
            if b and u < 1 << 20:
                shared = math.ceil(0.8 * n)
                assert (1 - shared / max(shared, u + n - shared)) ** b <= 1.01e-9


# SQL twins


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), oracle(SF), queries.ORACLES[name]) is None


# urls


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/en/1x?q#f", "x://a.com/de/", "x://com/fr/y", "x://example.org/es", "x://notexample.org/es/",
            "a://b://c/d", "x://h.example.org?/es/", "x://É.com#x", "http://s.co.uk/de/x", "x://"]
    pages = spark.createDataFrame([(i if i else None, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "n", "bad", "mean", "verdict")})
    outcomes = spark.createDataFrame([(3, True), (3, True), (4, None), (99, True), (None, True)], "page_id long, bad boolean")
    rows = {r.page_id or 0: r for r in url_filter.filter_urls(pages, outcomes, queries.URL_RULES).collect()}
    assert len(rows) == len(urls)
    want = {0: ("", "", None), 2: ("", "", None), 3: ("www.example.org", "/en/1x", "example.org/en/1"), 4: ("a.com", "/de/", "com/de/"), 5: ("com", "/fr/y", "com/fr/"),
            6: ("example.org", "/es", "org/"), 7: ("notexample.org", "/es/", "org/"), 8: ("b:", "//c/d", None), 9: ("h.example.org", "", None), 10: ("É.com", "", None)}
    for i, w in want.items():
        assert (rows[i].host, rows[i].path, rows[i].rule) == w
    assert rows[3].verdict == "block" and rows[6].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    assert url_filter.filter_urls(pages, outcomes.limit(0), queries.URL_RULES).count() == len(urls)


def test_reputation_shrinks_to_the_parent(spark):
    hosts = [(f"h{i}.good{i % 5}.com", 20.0, 1.0) for i in range(30)] + [("bad.spam.net", 200.0, 180.0), ("few.spam.net", 2.0, 1.0), ("new.spam.net", 0.0, 0.0), ("x.co.uk", 3.0, 0.0)]
    rows = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(hosts, "host string, n double, bad double")).collect()}
    assert rows["bad.spam.net"].bound > 0.8
    assert rows["new.spam.net"].mean > 0.5 > rows["h1.good1.com"].mean  # the domain speaks for a new host
    assert rows["few.spam.net"].bound < rows["bad.spam.net"].bound
    domains = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    got = [tuple(r) for r in domains.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


# mixing


def test_mixture_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, cases.words(rng, rng.randrange(1, 40)), "big" if i % 3 else f"s{i % 4}" if i % 4 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("cost", "epoch", "key", "cut")})
    cost = {i: max(len(t.split()), 1) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += cost[i]
    for how in (mixing.Mixture(entropy=0.97, block_tokens=200), mixing.Mixture(entropy=0.999, repeats=1.5, budget=1.2, block_tokens=300)):
        got = mixing.mixed(docs, how).collect()
        table = {r.key[1:] or None: r for r in mixing.plan(docs, how, "doc_id", "text", "source").collect()}
        weights = [r.weight for r in table.values()]
        bent = table["big"].exponent
        raw = {s: (t / sum(total.values())) ** bent for s, t in total.items()}
        assert all(table[s].weight == pytest.approx(raw[s] / sum(raw.values())) for s in total)
        repeats = max(r.target / r.tokens for r in table.values())
        assert repeats <= how.repeats + 0.01
        entropy = -sum(w * math.log(w) for w in weights) / math.log(len(weights))
        assert entropy == pytest.approx(how.entropy, abs=1e-4) or repeats == pytest.approx(how.repeats, abs=0.01)
        spent = Counter()
        for r in got:
            spent[r.source] += cost[r.doc_id]
        for s, r in table.items():
            assert 0 <= r.target - spent[s] < 40
        seen = Counter((r.doc_id, r.epoch) for r in got)
        assert max(seen.values()) == 1
        times = Counter(r.doc_id for r in got)
        assert all(times[i] in (table[s].passes, table[s].passes + 1) for i, _, s in rows)
        blocks = defaultdict(set)
        for r in got:
            blocks[r.block_order].add((r.source, r.epoch))
        assert all(len(b) == 1 for b in blocks.values())


def test_mixture_without_a_budget_reads_every_document(spark):
    """One of 20 sources holds a third of the words: its weight is below its share, yet all of it is read."""
    rows = [(i, "a b c d e f g h i j", "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(1900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for repeats, fewest in ((4.0, 1.5), (1.5, 1.0)):
        how = mixing.Mixture(budget=None, repeats=repeats, block_tokens=300)
        got = mixing.mixed(docs, how).collect()
        times = Counter(r.doc_id for r in got)
        assert set(times) == {r[0] for r in rows} and len({(r.doc_id, r.epoch) for r in got}) == len(got)
        read, size = Counter(r.source for r in got), Counter(r[2] for r in rows)
        assert read["hot"] == size["hot"]
        most = max(read[s] / size[s] for s in size)
        assert fewest < most <= repeats + 0.02
        # weights follow shares to one exponent, in the least unequal way that is allowed
        plan = {r.key[1:]: r for r in mixing.plan(docs, how, "doc_id", "text", "source").collect()}
        bent = {s: (size[s] / 1900) ** plan[s].exponent for s in size}
        assert all(abs(plan[s].weight - bent[s] / sum(bent.values())) < 1e-9 for s in size)
        assert plan["hot"].exponent < 1


def test_query_of_mixing_bends_shares(spark):
    """The parts of the given tables are unequal, so the query's weights come from the bisection."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = docs.withColumn("part", F.to_json(F.struct("source", "lang")))
    plan = mixing.plan(part, mixing.Mixture(), "doc_id", "text", "part").collect()
    assert plan[0].exponent < 0.9
    want = mixing.mixed(part, source_col="part").count()
    assert queries.op6_source_mixing(spark, "/root/testdata/sf0.001").count() == want


def test_mixture_of_odd_rows(spark):
    rng = random.Random(7)
    texts = cases.odd_texts(rng)
    docs = cases.documents(spark, [*texts, texts[6], texts[6]], ids=[*range(len(texts)), None, None])
    rows = mixing.mixed(docs, mixing.Mixture(entropy=0.0))
    assert rows.count() == len(texts) + 2 and set(docs.columns) <= set(rows.columns)  # own shares, budget 1: all once
    assert mixing.mixed(cases.empty(spark)).count() == 0


# n-gram Jaccard join


def groups(texts, how):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + how.size]) for j in range(len(w) - how.size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if how.den * common >= how.num * (len(sets[i]) + len(sets[j]) - common):
                    a, b = top(i), top(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


HOWS = [parity_join.Similarity(3, 90, 100, 0), parity_join.Similarity(5, 80, 100, 1), parity_join.Similarity(2, 60, 100, 1)]


def test_sketches_fold_and_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 65), (64, 70), (300, 340), (5_000, 4_000), (50_000, 40_000)]:
        union = np.unique(rng.integers(0, 2**63, n + m, np.int64).view(np.uint64))
        left, right = union[:n], union[n // 2 : n // 2 + m]
        apart = len(np.setxor1d(left, right))
        for most in (parity_join.BUCKET_WORDS, parity_join.MOST_WORDS):
            both = np.array([parity_join.sketch_of(left, most), parity_join.sketch_of(right, most)], object)
            a, b = parity_join.folded(both)
            assert np.bitwise_count(a ^ b).sum() <= apart
            short = min(both, key=len)
            assert any(row.tobytes() == short for row in (a, b))


@pytest.mark.parametrize("how", HOWS, ids=str)
def test_linked_groups_by_brute_force(spark, how):
    rng = random.Random(8)
    texts = cases.odd_texts(rng)
    for n in (3, 8, 12, 25, 40, 70, 150, 400):
        base = cases.words(rng, n).split()
        for edits in (0, 1, 1, 2, 3, 5, 8, 13):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy) + (" tail" * (edits % 2)))
    centre = cases.words(rng, 120).split()
    for _ in range(60):  # a group whose members link with the centre and partly with each other
        copy = list(centre)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [cases.words(rng, 30, 12) for _ in range(30)]
    want = groups(dict(enumerate(texts)), how)
    docs = cases.documents(spark, [*texts, texts[6]], ids=[*range(len(texts)), None])
    rows = parity_join.linked_groups(docs, how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(want[6][0], None)]


def test_texts_and_keys_are_sent_in_parts(spark, monkeypatch):
    """No step has all of them on disk at once; the parts together have every text and key."""
    rng = random.Random(4)
    base = [cases.words(rng, 40, 400) for _ in range(30)]
    texts = [t for t in base for _ in range(2)] + [f"{t} more" for t in base]
    made, real = [], parity_join.written
    monkeypatch.setattr(parity_join, "written", lambda df, name, **k: (made.append((name, df.count(), df.columns)), real(df, name, **k))[1])
    got = {r.doc_id: r.component_id for r in parity_join.linked_groups(cases.documents(spark, texts), HOWS[0]).collect()}
    assert got == {i: i // 2 * 2 if i < 60 else (i - 60) * 2 for i in range(90)}
    sketches = [n for name, n, _ in made if name == "sketches"]
    assert len(sketches) == parity_join.SKETCH_PARTS and sum(sketches) == 60 and max(sketches) < 60
    buckets = [n for name, n, columns in made if name == "buckets" and columns == ["key", "id"]]
    assert len(buckets) == parity_join.KEY_PARTS and max(buckets) < sum(buckets)


def test_linked_groups_of_repeated_ids_and_empty_tables(spark):
    rng = random.Random(9)
    a, b = cases.words(rng, 50), cases.words(rng, 50)
    docs = cases.documents(spark, [a, b, a, b, b], ids=[7, 7, 3, 5, 5])
    rows = parity_join.linked_groups(docs, HOWS[0]).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (5, 5), (5, 5), (7, 3), (7, 3)]
    assert parity_join.linked_groups(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("how", HOWS, ids=str)
def test_linked_sets_share_a_key(how):
    """Pigeonhole, at the edge: differences up to the most that linked sets may have, put into different words."""
    import numpy as np

    rng = np.random.default_rng(10)
    for n in [*range(1, 40), 77, 200, 901]:
        base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        for gone in range(n):
            left = np.sort(base[gone:])
            for new in (0, gone // 2, gone):
                other = np.sort(np.concatenate((left, rng.integers(0, 2**63, new, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
                if how.den * len(left) < how.num * (n + len(other) - len(left)) or not len(other):
                    continue
                assert np.isin(how.keys(np.sort(base)), how.keys(other)).any(), (n, gone, new)
            if how.den * len(left) < how.num * n:
                break


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# surrogates

PEOPLE = (
    "Mr. John SMITH met Mrs. Smith and Smith. г-жа Иванова; Und.34@mail7.example.com, und.34@MAIL7.example.com "
    "+1 (743) 555-3824 or 743-555-3824 at 97.51.17.173. 4111 1111 1111 1111 9807915762804490 123-45-6789 v1.2.3.4.5 a@b"
)


def test_surrogates_keep_type_format_and_coreference():
    found = pii.entities(PEOPLE)
    kinds = [e.kind for e in found]
    assert kinds == ["given_m_latin", "family_latin", "family_latin", "family_latin", "family_cyrillic", "email", "email", "phone", "phone", "ip", "card", "card", "ssn"]
    key = b"k" * 32
    text, n = pii.replaced(PEOPLE, key, {})
    again = pii.entities(text)
    assert n == len(found) == len(again) and [e.kind for e in again] == kinds
    assert [pii.script_of(e.canon) for e in again[:5]] == ["latin"] * 4 + ["cyrillic"]
    assert pii._GIVEN[again[0].canon] == "m" and text[again[1].start : again[1].end].isupper()
    for group in ((1, 2, 3), (5, 6), (7, 8)):
        assert len({again[i].canon for i in group}) == 1
    assert not {e.canon for e in found} & {e.canon for e in again}
    for a, b in zip(found, again, strict=True):
        if a.kind in ("phone", "card", "ssn"):
            assert re.sub(r"\d", "9", PEOPLE[a.start : a.end]) == re.sub(r"\d", "9", text[b.start : b.end])
    assert pii._luhn(again[10].canon) == 0
    assert pii.replaced(PEOPLE, b"other" * 4, {})[0] != text
    assert pii.replaced(None, key, {}) == (None, 0) and pii.replaced("clean text", key, {}) == ("clean text", 0)


# Planted, not found: what stands in the text, and what it is.
PHONES = {
    "+1 (826) 555-4081": "8265554081", "+1 826.555.4081": "8265554081", "826-555-4081": "8265554081", "8265554081": "8265554081",
    "18265554081": "8265554081", "(826)555-4081": "8265554081", "+44 20 7946 0958": "+442079460958", "+44 (0)20 7946 0958": "+442079460958",
    "+33 6 12 34 56 78": "+33612345678", "+33612345678": "+33612345678",
}
OTHERS = {
    "190.137.223.204": ("ip", "190.137.223.204"), "10.0.0.7": ("ip", "10.0.0.7"), "4111 1111 1111 1111": ("card", "4111111111111111"),
    "4111-1111-1111-1111": ("card", "4111111111111111"), "9807915762804490": ("card", "9807915762804490"), "123-45-6789": ("ssn", "123456789"),
}


@pytest.mark.parametrize("gap", [" ", "  ", ", ", "\n", " | ", "-", "/"])
def test_neighbouring_numbers_are_entities_of_their_own(gap):
    planted, key = {p: ("phone", c) for p, c in PHONES.items()} | OTHERS, b"k" * 32
    alone = {p: pii.replaced(f"at {p} now", key, {})[0][3:-4] for p in planted}
    for a, b in [(a, b) for a in planted for b in planted if a in PHONES or b in PHONES]:
        if gap == "-" and b[0].isdigit() and planted[a][0] == "ssn":  # no such number is followed by more digits
            continue
        text = f"at {a}{gap}{b} now"
        assert [(text[e.start : e.end], e.kind, e.canon) for e in pii.entities(text)] == [(a, *planted[a]), (b, *planted[b])]
        assert pii.replaced(text, key, {}) == (f"at {alone[a]}{gap}{alone[b]} now", 2)
    by_number = {}
    for p, c in PHONES.items():
        assert re.sub(r"\d", "9", p) == re.sub(r"\d", "9", alone[p]) and alone[p] != p
        assert by_number.setdefault(c, pii.entities(alone[p])[0].canon) == pii.entities(alone[p])[0].canon


@pytest.mark.parametrize("local", ["josé", "jose\u0301.maría", "иван.п", "a" * 65, "x." * 5000 + "y", "étienne+news", "José_1"])
def test_the_whole_local_part_goes(local):
    text = f"to <{local}@mail.example.com>, then"
    assert [(e.start, e.end, e.kind) for e in pii.entities(text)] == [(4, len(text) - 7, "email")]
    new, n = pii.replaced(text, b"k" * 32, {})
    assert n == 1 and local not in new and new.startswith("to <") and new.endswith(".example>, then")


def test_phones_end_where_their_plan_does():
    for text, want in {
        "+1 (826) 555-4081 2024": ["+1 (826) 555-4081"], "+44 20 7946 0958 2024": ["+44 20 7946 0958"], "+49 30 1234 4111 1111 1111 1111": ["+49 30 1234", "4111 1111 1111 1111"],
        "+1 (826) 555-4081 190.137.223.300": ["+1 (826) 555-4081"], "+999 1234 5678 190.137.223.300": ["+999 1234 5678"], "+1 190.137.223.204": ["190.137.223.204"],
        "0175557713": [], "+1 (017) 555-7713 or 0175557713": ["+1 (017) 555-7713", "0175557713"], "442079460958": [], "1700000000 5558264081.5 3.5558264081 id_5558264081 C++11": [],
    }.items():
        assert [text[e.start : e.end] for e in pii.entities(text)] == want, text


def test_surrogates_stay_distinct_over_the_table(spark):
    rng = random.Random(11)
    names = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Paul"]
    texts = [f"Mr. {names[i % 10]} {chr(65 + i % 26)}{'aeiou'[i // 26 % 5]} wrote from 10.0.0.{i % 250} to u{i % 120}@x.org" for i in range(400)] + [None, "", "none"]
    docs = cases.documents(spark, texts + texts[:3], ids=[*range(len(texts)), None, None, None])
    rows = pii.with_surrogates(docs, "secret", count_col="n").collect()
    assert len(rows) == len(texts) + 3
    mapping, back = {}, {}
    for r in rows:
        if r.doc_id is None:
            continue
        old, new = pii.entities(texts[r.doc_id]), pii.entities(r.text)
        assert r.n == len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            assert mapping.setdefault((a.kind, a.canon), b.canon) == b.canon
            assert back.setdefault((a.kind, b.canon), a.canon) == a.canon
    real = {(k, c) for k, c in mapping}
    assert not real & set(back) and len([1 for k, _ in real if k.startswith("given_m")]) == 10
    assert {r.text for r in rows if r.doc_id in (400, 401, 402)} == {None, "", "none"}
    assert pii.with_surrogates(cases.empty(spark), "secret").count() == 0


# revisits


def test_revisits_by_brute_force(spark):
    rng = random.Random(12)
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['www.', ''])}H{k % 5}.org/{k % 3}{rng.choice(['', '/', '#x', '?utm_a=1', '?b=2&a=1', '?a=1&b=2'])}" for k in range(60)]
    urls += ["http://hot.org/"] * 240 + [None, ""]
    rows = []
    for i, u in enumerate(urls):
        tags = {rng.choice(["ETag", "etag"]): rng.choice(['"1"', 'W/"1"', '"2"'])} if rng.random() < 0.6 else {}
        tags |= {"Last-Modified": rng.choice("ab")} if rng.random() < 0.6 else {}
        tags |= {"Content-Length": str(i), rng.choice(["X-A", "x-a"]): str(i)}
        rows.append((i, u, rng.choice([None, *range(90)]) if i % 20 == 0 else rng.randrange(90), rng.choice(["response", "revisit", "request"]), rng.choice("de"), tags if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, digest string, headers map<string,string>")
    df = df.withColumns({"curl": F.lit("clash"), "own": F.lit(1), "found": F.lit(1)})
    canon = {r.url: r.c for r in df.select("url", revisits.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    assert canon["http://hot.org/"] == "hot.org" and len({c for u, c in canon.items() if u and "b" in u and "a=1&" not in u}) <= 15
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    want = {}
    for i, u, t, kind, digest, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and u is not None and r[1] is not None and canon[r[1]] == canon[u] and t is not None and r[2] is not None and r[2] < t]
        if not earlier:
            want[i] = (None, "no_response", None)
            continue
        r = max(earlier, key=lambda r: (r[2], r[0]))
        old, new = low(r[5]), low(headers)
        strip = lambda e: e.removeprefix("W/")
        if "etag" in old and "etag" in new:
            same = strip(old["etag"]) == strip(new["etag"])
        elif "last-modified" in old and "last-modified" in new:
            same = old["last-modified"] == new["last-modified"]
        else:
            same = r[4] == digest
        merged = old | {k: v for k, v in new.items() if k not in revisits.KEPT_HEADERS}
        want[i] = (r[0], "resolved" if same else "mismatch", merged if same else None)
    got = {r.record_id: (r.response_id, r.status, r.merged) for r in revisits.resolve_revisits(df).collect()}
    assert got == want and Counter(w[1] for w in want.values()).keys() == {"resolved", "mismatch", "no_response"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op3_revisit_resolution(spark, SF).collect()
    assert len(rows) == revisits.captures_of(pages).where("kind = 'revisit'").count() > pages.count()


# the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [shingled(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "source_mix":
            assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        seen.append(name)
        ids = {r.doc_id for r in after}
        if name == "quality":
            gone = [labels[r.doc_id] for r in before if r.doc_id not in ids and r.doc_id in labels]
            kept = [labels[r.doc_id] for r in after if r.doc_id in labels]
            assert gone.count(1) <= 0.05 * kept.count(1) and kept.count(0) <= 0.2 * max(1, gone.count(0))
        elif name == "near_duplicates":
            want = groups({r.doc_id: r.text for r in before}, parity_join.Similarity())
            assert ids == {i for i, (_, comp) in want.items() if i == comp}
        elif name == "benchmark_leaks":
            leaking = {r.doc_id for r in before if any(100 * len(shingled(r.text) & q) >= 80 * len(q) for q in bench)}
            assert leaking and ids == {r.doc_id for r in before} - leaking
        elif name == "personal_data":
            old = {e.canon for r in before for e in pii.entities(r.text)}
            assert old and not old & {e.canon for r in after for e in pii.entities(r.text)}
            assert ids == {r.doc_id for r in before} and all(r.n_chars == len(r.text) for r in after)
        else:
            assert len({(r.block_order, r.doc_order) for r in after}) == len(after) > 0
        docs = spark.createDataFrame(after, docs.schema) if name != "source_mix" else docs
    assert seen == [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def _largest_batch(docs) -> int:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    return docs.select("text").mapInArrow(run, "bytes long").agg(F.max("bytes")).first()[0]


@pytest.fixture
def setting(spark):
    """The name of a setting that stages make; unset before and after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    yield name
    spark.conf.unset(name)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "personal_data"])
def test_texts_go_to_python_in_small_batches(spark, tmp_path, setting, name):
    rng = random.Random(11)
    cases.documents(spark, [cases.words(rng, 600) for _ in range(1200)], clashing=False).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stage, before = dict(corpus_pipeline.STAGES)[name], _largest_batch(docs)
    made = stage(spark, docs, SF)
    assert before > 3 << 20 and _largest_batch(docs) < 3 << 19
    assert made.columns == corpus_pipeline.COLUMNS
    spark.conf.set(setting, "3m")
    stage(spark, docs.limit(10), SF)
    assert spark.conf.get(setting) == "3m"


def test_pipeline_leaves_the_session_as_it_was(spark, setting):
    corpus_pipeline.run(spark, SF)
    assert spark.conf.get(setting, None) is None


def test_leaks_start_no_python_workers(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = cases.documents(spark, [" ".join(words), "other text " * 20, None])
    items = spark.createDataFrame([(1, " ".join(words[5:30])), (2, "none of these words")], "item_id long, text string")

    def refused(*args, **kwargs):
        raise AssertionError("createDataFrame")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).orderBy("doc_id").collect()] == [1, 2]


def test_copies_go_row_by_row(spark):
    """Repeated rows, null ids and one id with two texts: one row of each group stays, and nothing else goes."""
    rng = random.Random(17)
    a, b, c, d, e = (cases.words(rng, 60) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (4, a), (4, c), (None, d), (None, d), (None, d), (None, a), (None, e), (5, "x y"), (5, "x y"), (6, "x y"), (7, None), (None, None), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == Counter([(1, a), (3, b), (4, c), (None, d), (None, e), (5, "x y"), (7, None), (None, None)])


@pytest.mark.parametrize(("block", "rounds"), [(3, 0), (8, 1)])
def test_linked_groups_in_small_blocks(spark, monkeypatch, block, rounds):
    """The comparison of sketches alone, over many blocks, finds all links."""
    monkeypatch.setattr(parity_join, "BLOCK", block)
    monkeypatch.setattr(parity_join, "HUB_ROUNDS", rounds)
    rng = random.Random(13)
    centre, texts = cases.words(rng, 90).split(), []
    for _ in range(70):
        copy = list(centre)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    how = HOWS[0]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.linked_groups(cases.documents(spark, texts, clashing=False), how).collect()}
    assert got == groups(dict(enumerate(texts)), how)
