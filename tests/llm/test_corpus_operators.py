"""Each operator against a brute-force version, on small fixtures with the odd cases in them."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import fingerprints, language_model, media, mixing, ngram_join, packing, quality, substrings, toxicity, warc
from tidemark.llm.textnum import Words
from tidemark.runtime import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def rows_of(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [words(rng, rng.randrange(5, 160)) for _ in range(60)]
    passage = words(rng, 70, 10**6)
    texts += [f"{words(rng, 30, 10**6)} {passage} {words(rng, 20, 10**6)}" for _ in range(4)]
    base = words(rng, 120, 10**6).split()
    for k in range(6):
        copy = list(base)
        for j in range(k):
            copy[(j * 17) % 120] = f"x{k}{j}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], None, "", "  \t ", "one", "one two three", "One TWO\tthree", "ä é\x0bñ ü x y z", words(rng, 3000, 50), "a " * 200]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here at all today", None, None, 5)]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_words_match_bytes_split():
    texts = ["", " a  B\tc\n", "é È x", "q", "\x0b\x0c"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    flat = [x for r in raw for x in r.lower().split()]
    low = b"".join(raw).lower()
    assert [low[a:b] for a, b in zip(w.start, w.end, strict=True)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))


# 1 packing


def naive_fit(pieces: list[tuple], capacity: int) -> list[int]:
    bins: list[tuple[int, set, set]] = []
    out = []
    for size, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append((capacity, set(), set()))
            i = len(bins) - 1
        bins[i] = (bins[i][0] - size, bins[i][1] | {source}, bins[i][2] | {cluster})
        out.append(i)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(20):
        pieces = sorted(((rng.randrange(0, 50), f"s{rng.randrange(4)}", rng.randrange(30)) for _ in range(80)), key=lambda p: -p[0])
        assert packing.best_fit(pieces, 60) == naive_fit(pieces, 60)


def test_pack(spark, docs, rows):
    got = packing.pack(spark, docs, capacity=100, shard_rows=40).collect()
    by_doc = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    want = collections.Counter()
    for r in rows:
        want[r[0]] += len(tokens(r[1]))
    assert by_doc == want
    for b in bins.values():
        assert sum(r.n_words for r in b) == b[0].bin_words <= 100
        assert len({r.source for r in b}) == len(b) == len({r.cluster for r in b})


# 2 mixing


def targets(sizes: dict, weights: list[float]) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (goal - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix(spark, docs, rows):
    got = mixing.mix(spark, docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    want = targets(dict(sizes), [3.0, 1.0, 2.0])
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert taken[s] == math.floor(t + 1e-9)
    again = mixing.mix(spark, docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_rows(spark, docs):
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(spark, docs).collect()}
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    n = collections.Counter(r.doc_id for r in out.collect())
    for (doc_id, size), t in taken.items():
        if doc_id is not None and doc_id != 5:
            assert abs(n[doc_id] - (t / size if size else 0)) <= 0.5


# 3 quality


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        text = words(rng, 40) if good else " ".join(f"{x}***" for x in words(rng, 40).split())
        rows.append((i, text, "en", "s", 1))
        labels.append((i, good, int(i % 3 == 0)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit_on(docs, lab)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.selected == r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.expected_grade <= 3 and 0 <= r.tail_probability <= 1 for r in got)


def test_ordinal_likelihood_has_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.BINS + 6)).astype(np.float32) * 0.01
    x[:, 0] = rng.normal(size=400)
    grade = np.clip(np.round(x[:, 0] + 1.5), 0, 3).astype(int)
    m = quality.fit(x, grade)
    assert (np.diff(m.thresholds) > 0).all()
    assert np.corrcoef(x @ m.weights, grade)[0, 1] > 0.9


# 4 WARC


def test_warc(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    html = [None, "", "a" * 1500, "a" * 1500, "b" + inner + "é" * 600, inner, inner * 30, "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n", "é" * 499, "é" * 500, "é" * 500]
    pages = [(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)] + [(None, None, "z" * 2000), (3, "u", "z" * 2000), (3, "u", "z" * 2000), (9, "k", "z" * 2000)]
    head: dict = {}
    for p, _, h in pages:
        if p is not None:
            head[h or ""] = max(head.get(h or "", -1), p)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and p != head.get(h or "")
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head[h or ""] if again else None, True))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for parts in (1, 3):
        got = warc.archive_and_read(spark, frame.repartition(parts)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_reachable_rejects_chains_inside_payloads():
    offset = np.array([0, 10, 25, 40, 60])
    following = np.array([40, 25, 60, 60, 90])
    assert warc.reachable(offset, following).tolist() == [True, False, False, True, True]
    assert not warc.reachable(offset + 1, following).any()


# 5 substrings


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for n, least in ((30, 7), (64, 5), (100, 20)):
        v = rng.integers(0, 2**63, n).astype(np.uint64)
        doc = np.sort(rng.integers(0, 3, n))
        got = set(zip(*(a.tolist() for a in substrings.windows(v, doc, least)), strict=True))
        want = set()
        for c in range(n):
            a = b = c
            while a > 0 and doc[a - 1] == doc[c] and v[a - 1] > v[c]:
                a -= 1
            while b < n - 1 and doc[b + 1] == doc[c] and v[b + 1] > v[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((c, a, b))
        assert got == want


def test_equal_hashes_end_no_window():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, least = 60, 9
        v = (rng.integers(0, 12, n) << 30).astype(np.uint64)
        doc = np.sort(rng.integers(0, 2, n))
        got = set(zip(*(a.tolist() for a in substrings.windows(v, doc, least)), strict=True))
        want = set()
        for c in range(n):
            a = b = c
            while a > 0 and doc[a - 1] == doc[c] and v[a - 1] >= v[c]:
                a -= 1
            while b < n - 1 and doc[b + 1] == doc[c] and v[b + 1] >= v[c]:
                b += 1
            first = any(doc[i] == doc[i + least - 1] == doc[c] and int(np.argmin(v[i : i + least])) + i == c for i in range(max(0, c - least + 1), min(c, n - least) + 1))
            if first:
                want.add((c, a, b))
        assert got == want


def test_substrings_find_repeated_passages(spark, docs, rows):
    got = substrings.find(spark, docs).collect()
    found = collections.defaultdict(list)
    texts = {r[0]: tokens(r[1]) for r in rows if r[0] is not None}
    for r in got:
        assert r.similarity >= 0.8 and r.doc_id > r.other_id
        found[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    seen: dict = {}
    for i in sorted(texts):
        grams = [tuple(texts[i][j : j + 51]) for j in range(len(texts[i]) - 50)]
        for j, g in enumerate(grams):
            if g in seen and seen[g] != i and len(set(g)) > 40:
                assert any(a <= j and j + 51 <= b for a, b in found[i]), (i, j)
        for g in grams:
            seen.setdefault(g, i)


def edited(words: list[str], at: list[int]) -> list[str]:
    return [f"edit{i}" if i in at else w for i, w in enumerate(words)]


def grams(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(len(words) - 4)], np.uint64)


@pytest.mark.parametrize(("n", "at"), [(51, [25]), (51, [0]), (51, [2]), (60, [30]), (89, [44]), (100, [33, 66]), (150, [38, 75, 112])])
def test_edited_passages_match(n, at):
    rng = random.Random(n)
    passage = words(rng, n, 10**6).split()
    a = [*words(rng, 20, 10**6).split(), *passage, *words(rng, 20, 10**6).split()]
    b = [*words(rng, 35, 10**6).split(), *edited(passage, at), *words(rng, 9, 10**6).split()]
    (x0, x1, y0, y1, j), = substrings.matches(grams(a), grams(b), 47, 0.8)
    assert j >= 0.8 and min(x1 - x0, y1 - y0) >= 46
    # All but words at the ends that no shared shingle holds.
    inner = [i for i in range(n) if any(not set(range(s, s + 5)) & set(at) for s in range(max(0, i - 4), min(i, n - 5) + 1))]
    assert x0 <= 20 + inner[0] and 20 + inner[-1] <= x1 + 4 and y0 <= 35 + inner[0] and 35 + inner[-1] <= y1 + 4


def test_matches_equal_brute_force():
    rng = np.random.default_rng(8)
    least, n_found = 10, 0
    for _ in range(25):
        a = rng.choice(10**6, 26, replace=False).astype(np.uint64)
        b = a[int(rng.integers(0, 8)) :].copy()
        b[rng.choice(len(b), int(rng.integers(0, 5)), replace=False)] += np.uint64(10**7)
        b = np.delete(b, rng.choice(len(b), int(rng.integers(0, 3)), replace=False))
        got = substrings.matches(a, b, least, 0.8)
        # Shared places of all pairs of stretches, from counts over both sequences' beginnings.
        count = np.zeros((len(a) + 1, len(b) + 1), int)
        count[1:, 1:] = (a[:, None] == b[None, :]).cumsum(0).cumsum(1)
        for x0 in range(len(a) - least + 1):
            for x1 in range(x0 + least, len(a) + 1):
                strip = count[x1] - count[x0]
                s = strip[None, :] - strip[:, None]
                size = x1 - x0 + np.arange(len(b) + 1)[None, :] - np.arange(len(b) + 1)[:, None]
                long = size - (x1 - x0) >= least
                for y0, y1 in np.argwhere(long & (s > 0) & (s >= 0.8 * (size - s) - 1e-9)):
                    held = [x for x in range(x0, x1) if a[x] in b[y0:y1]]
                    assert any(g[0] <= held[0] and held[-1] <= g[1] for g in got)
                    n_found += 1
        assert all(j >= 0.8 and x1 - x0 >= least - 1 and y1 - y0 >= least - 1 for x0, x1, y0, y1, j in got)
    assert n_found


def test_substrings_find_an_edited_passage(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(20):
        passage = words(rng, 60, 10**6).split()
        texts += [" ".join([words(rng, 30, 10**6), *p, words(rng, 30, 10**6)]) for p in (passage, edited(passage, [30]))]
    got = substrings.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({(r.other_id, r.doc_id) for r in got} & {(2 * i, 2 * i + 1) for i in range(20)}) >= 19


def test_hot_and_cold_keys_give_equal_passages(spark):
    """With no key hot, every key hot and every second one: the same rows, among them copies behind frequent lines."""
    rng = random.Random(21)
    line, frequent = words(rng, 12, 10**6), words(rng, 40, 10**6)
    texts = [" ".join([words(rng, 40, 10**6), line, words(rng, 40, 10**6)]) for _ in range(20)]
    texts += [" ".join([words(rng, 25, 10**6), frequent, words(rng, 25, 10**6)]) for _ in range(20)]
    for _ in range(8):
        passage = words(rng, 30, 10**6) + " " + rng.choice([line, frequent]) + " " + words(rng, 30, 10**6)
        texts += [" ".join([words(rng, 20, 10**6), passage, words(rng, 20, 10**6)]) for _ in range(2)]
    rng.shuffle(texts)
    texts += [texts[0]] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    every = docs.mapInArrow(substrings._window_rows(5, 47, substrings.NO_KEYS), substrings._WINDOW).select("key").distinct()
    keys = np.array(sorted(r.key for r in every.collect()), np.int64)
    hots = [substrings.Hot(x, 1 + x % 3) for x in (keys[:0], keys, keys[::2])]
    with Scratch(spark, "test") as scratch:
        found = [sorted(tuple(r) for r in substrings.passages(spark, docs, scratch, hot=hot).collect()) for hot in hots]
    assert found[0] == found[1] == found[2]
    want = {(j, i) for i, t in enumerate(texts[:56]) for j, u in enumerate(texts[:56]) if i < j and len(set(grams(t.split())) & set(grams(u.split()))) > 60}
    assert len(want) == 8 and want <= {(r[0], r[1]) for r in found[0]}


def test_links_behind_lines_that_many_documents_share(spark):
    """Copies of a passage whose middle stands in many other documents, of smaller and greater ids, and groups of equal texts."""
    rng = random.Random(31)
    line = words(rng, 45, 10**6)
    texts = [" ".join([words(rng, 30, 10**6), line, words(rng, 30, 10**6)]) for _ in range(40)]
    for i in range(12):
        before, after = words(rng, 8, 10**6), words(rng, 8, 10**6).split()
        texts += [" ".join([words(rng, 30, 10**6), before, line, *edited(after, at), words(rng, 30, 10**6)]) for at in ([], [5] if i % 2 else [])]
    texts = [*texts[:20], *texts[40:], *texts[20:40]]
    texts += [texts[0]] * 50
    found = substrings.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pairs = {(r.other_id, r.doc_id) for r in found}
    assert {(20 + 2 * i, 21 + 2 * i) for i in range(12)} | {(0, i) for i in range(64, 114)} == pairs
    # A copy is one row.
    assert len(found) == 62 and all(r.n_words == 105 and r.similarity == 1 for r in found if r.doc_id >= 64)


def test_runs_of_one_word_are_no_pairs_of_all_documents(spark, monkeypatch):
    """Documents with a word over and over meet the longest run before them; others only where a second shingle is shared."""
    rng = np.random.default_rng(8)
    own = lambda i: [f"w{i}x{x}" for x in rng.integers(0, 10**6, 40)]
    length = [30, *(int(x) for x in rng.integers(20, 90, 38)), 80, 40, 40]
    shared = [f"s{i}" for i in range(15)]
    texts = [" ".join([*own(i), *["and"] * n, *(shared if i >= 40 else []), *own(i)]) for i, n in enumerate(length)]
    seen = []
    verify = substrings._verify

    def counted(s, docs, scratch, stretches, *a):
        seen.append(stretches.count())
        return verify(s, docs, scratch, stretches, *a)

    monkeypatch.setattr(substrings, "_verify", counted)
    found = substrings.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(seen) == 2 and seen[1] < 2 * len(texts)
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    for i in range(1, 40):
        n = min(length[i], max(length[:i]))
        assert len(spans.get(i, set()) & set(range(40, 40 + length[i]))) >= n if n >= 51 else i not in spans, i
    # A run of 40 words and 15 others are a passage together.
    assert any(r.doc_id == 41 and r.other_id == 40 and r.n_words >= 55 for r in found)


def test_similar_passages_share_a_run():
    """Edits placed as evenly as the similarity allows leave a run of ``exact_run`` shingles."""
    assert substrings.exact_run(5, 47, 0.8) == 21 and substrings.block_of(5, 47, 0.8) == (16, 10)
    rng = random.Random(6)
    for n in (51, 60, 89, 100, 150, 300):
        for edits in range(1, 9):
            passage = words(rng, n, 10**6).split()
            a, b = grams(passage), grams(edited(passage, [round((i + 1) * n / (edits + 1)) for i in range(edits)]))
            shared = len(np.intersect1d(a, b))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                assert substrings.runs(np.isin(a, b), 21)


def test_a_text_of_millions_of_shingles_has_the_same_windows(monkeypatch):
    v = np.random.default_rng(4).integers(0, 2**63, 5000).astype(np.uint64)
    doc = np.zeros(5000, np.int64)
    plain = substrings.windows(v, doc, 47)
    monkeypatch.setattr(substrings, "_AT", np.uint64(1023))
    assert all((a == b).all() for a, b in zip(plain, substrings.windows(v, doc, 47), strict=True))


def test_substrings_remove(spark, docs):
    out = {r.doc_id: r for r in substrings.remove(spark, docs).collect()}
    assert set(out) >= {r.doc_id for r in docs.collect() if r.text and r.text.strip()} - {70, 71, 0} - set(range(65, 72))
    first, later = tokens(out[60].text), [tokens(out[i].text) for i in (61, 62, 63)]
    assert len(first) == 120 and all(len(x) == 50 for x in later)
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out.values() if r.text and r.doc_id is not None)


# 6 n-gram join


def brute_components(rows: list[tuple], k: int, percent: int) -> dict:
    sets = {}
    for r in rows:
        w = tokens(r[1])
        sets[r[0]] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark, docs, k, percent).collect() if r.doc_id is not None}
    assert got == brute_components(rows, k, percent)


def test_ngram_join_of_random_near_copies(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, rng.randrange(30, 90), 10**6).split()
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy[: len(copy) - rng.randrange(0, 4)]), "en", "s", 1))
            i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize(("occurrences", "long"), [(1, 64), (2, 0), (3, 10**6), (6, 3)])
def test_short_lists_of_any_length_give_the_same_links(spark, monkeypatch, occurrences, long):
    rng = random.Random(6)
    line, texts = words(rng, 9, 10**6), []
    for _ in range(25):
        base = words(rng, 40, 300).split()
        texts += [" ".join([*base, line])] + [" ".join([w if rng.random() > 0.03 else "z" for w in base] + [line]) for _ in range(3)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(ngram_join, "OCCURRENCES", occurrences)
    monkeypatch.setattr(ngram_join, "LONG", long)
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark, spark.createDataFrame(rows, SCHEMA), 3, 60).collect()}
    want = brute_components(rows, 3, 60)
    assert got == {i: (v[1] if isinstance(v, tuple) else v) for i, v in want.items()}
    assert len(set(got.values())) < len(rows)


def test_probe_counts_like_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in "ab")
        both = len(np.intersect1d(a, b))
        assert ngram_join.probe(a, b, 60) == (100 * both >= 60 * (len(a) + len(b) - both) and both > 0)


# 7 language model


def test_language_model_base_score(spark, docs, rows):
    got = [r for r in language_model.train_and_score(spark, docs).collect() if r.doc_id is not None]
    count = collections.Counter()
    for r in rows:
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10:
            count.update([*tokens(r[1]), None])
    n, v = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = [*tokens(text[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[x] > 0 for x in t), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r.score < 0


# 8 fingerprints


def test_fingerprints(spark, rows):
    plain = [r for r in rows if r[0] is not None and r is not rows[-2]][:78]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark, spark.createDataFrame(plain, SCHEMA)).collect()}
    order = sorted(plain, key=lambda r: -r[0])
    errors = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = collections.Counter(tokens(text)), collections.Counter(tokens(edited))
        union = sum((a | b).values())
        errors.append(g.near_edited - (sum((a & b).values()) / union if union else 1.0))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.15
    assert got[0].fingerprint == got[70].fingerprint == got[71].fingerprint


# 9 media


def test_texts_without_words_have_no_fingerprint(spark):
    rows = [(4, ""), (3, " \t "), (2, None), (1, "some words"), (0, "")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].fingerprint for i in (4, 3, 2, 0)] == [""] * 4 and len(got[1].fingerprint) == 8 * fingerprints.SAMPLES
    assert (got[4].near_next, got[3].near_next, got[2].near_next, got[1].near_next) == (1.0, 1.0, 0.0, 0.0)


def test_very_long_texts(spark, labels):
    """A text of over a megabyte of words beside short ones: whole results."""
    rng = random.Random(14)
    long = words(rng, 200_000, 10**6)
    assert len(long) > 10**6
    texts = [long, "short text here", long[:-7] + " the end", words(rng, 60, 10**6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    n = [len(t.split()) for t in texts]
    found = [r for r in substrings.find(spark, docs).collect() if r.doc_id == 2]
    assert {r.other_id for r in found} == {0} and sum(r.n_words for r in found) >= n[0] - 10
    assert {r.doc_id: r.component_id for r in ngram_join.join(spark, docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    assert {r.doc_id: r.n_tokens for r in language_model.train_and_score(spark, docs).collect()} == {i: k + 1 for i, k in enumerate(n)}
    assert {r.doc_id: r.payload_sha256 for r in media.store_and_read(spark, docs).collect()}[0] == hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest()
    assert {r.doc_id: r.size for r in mixing.mix(spark, docs).collect()} == dict(enumerate(n))
    pieces = packing.pack(spark, docs).groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in pieces} == dict(enumerate(n))
    assert quality.score(docs, quality.fit_on(docs, labels)).count() == 4


def test_media_round_trip(spark, docs, rows):
    text = {r[0]: (r[1] or "").encode() for r in rows}
    got = media.store_and_read(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        b = text[r.doc_id]
        payload = b + bytes(-len(b) % 64 if b else 64)
        stored = media.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(payload)


def test_cuts_follow_content():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 300_000).astype(np.uint8).tobytes()
    ends = media.cuts(data, 1024, 11, 16384)
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= 16384
    moved = media.cuts(b"x" * 777 + data, 1024, 11, 16384)
    pieces = {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    shifted = b"x" * 777 + data
    again = [shifted[a:b] for a, b in zip([0, *moved], moved, strict=False)]
    assert np.mean([p in pieces for p in again]) > 0.9
    slow, h = [], 0
    gear = media._GEAR.astype(int)
    at = 0
    for i, byte in enumerate(data[:60_000]):
        h = ((h << 1) + int(gear[byte])) & 0xFFFFFFFF
        if (i + 1 - at >= 1024 and h >> 21 == 0) or i + 1 - at == 16384:
            slow.append(i + 1)
            at = i + 1
    assert slow == [e for e in ends if e <= 60_000][: len(slow)]


def test_near_copies_share_chunks(spark):
    rng = random.Random(2)
    base = words(rng, 1500, 10**6)
    near = [base[: 500 * k] + f" an edit {k} " + base[500 * k :] for k in range(1, 12)]
    lists = [[media._name(c) for c in media._pieces(media.wav(t.encode()))] for t in (base, *near)]
    assert len(lists[0]) > 5
    for other in lists[1:]:
        assert len(set(other) & set(lists[0])) >= 0.6 * len(lists[0])
    distinct = {name for own in lists for name in own}
    assert len(distinct) < 0.45 * sum(map(len, lists))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([base, *near])], "doc_id long, text string")
    got = {r.doc_id: r.payload_sha256 for r in media.store_and_read(spark, docs).collect()}
    assert got == {i: hashlib.sha256(t.encode() + bytes(-len(t.encode()) % 64)).hexdigest() for i, t in enumerate([base, *near])}


# 10 toxicity


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rng, 40).split()
        for _ in range(4 if bad else 0):
            t[rng.randrange(40)] = rng.choice(["idiot", "zorgle", "st0rk"])
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame([*rows, (1000, None, None, None, None)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(spark, docs, toxicity.fit_on(spark, docs, lab)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(spark, docs, lab).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    a, b = toxicity.isotonic(x, y)
    assert (np.diff(a) >= 0).all() and (np.diff(b) >= 0).all()


# Odd tables

APPLY = {
    "pack": lambda s, d, lab: packing.pack(s, d),
    "mix": lambda s, d, lab: mixing.mix(s, d),
    "mixed": lambda s, d, lab: mixing.mixed(s, d),
    "quality": lambda s, d, lab: quality.score(d, quality.fit_on(d, lab)),
    "substrings": lambda s, d, lab: substrings.find(s, d),
    "remove": lambda s, d, lab: substrings.remove(s, d),
    "join": lambda s, d, lab: ngram_join.join(s, d),
    "keep_one": lambda s, d, lab: ngram_join.keep_one(s, d),
    "language_model": lambda s, d, lab: language_model.train_and_score(s, d),
    "fingerprints": lambda s, d, lab: fingerprints.fingerprint_edits(s, d),
    "media": lambda s, d, lab: media.store_and_read(s, d),
    "toxicity": lambda s, d, lab: toxicity.score(s, d, toxicity.fit_on(s, d, lab)),
    "keep_clean": lambda s, d, lab: toxicity.keep_clean(s, d, lab),
}
KEEPS_ROWS = {"mix", "quality", "join", "language_model", "fingerprints", "media", "toxicity"}


@pytest.mark.parametrize("name", APPLY)
def test_empty_table(spark, docs, labels, name):
    assert APPLY[name](spark, docs.filter("false"), labels).count() == 0


def test_empty_pages(spark):
    assert warc.archive_and_read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", APPLY)
def test_nulls_repeats_and_clashing_columns(spark, rows, labels, name):
    clash = ["score", "row", "key", "size", "class", "kept", "spans", "cut_id", "w", "range", "g", "taken", "shard", "component_id"]
    odd = [(*r, *range(len(clash))) for r in [*rows[:70:7], *rows[-12:], (None, None, None, None, None)]]
    docs = spark.createDataFrame(odd, SCHEMA + "".join(f", `{c}` int" for c in clash))
    out = APPLY[name](spark, docs, labels)
    n = out.count()
    if name in KEEPS_ROWS:
        assert n == len(odd)
    if name in ("mixed", "remove", "keep_one", "keep_clean"):
        assert out.columns == docs.columns
