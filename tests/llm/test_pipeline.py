"""The pipeline's stages on the smallest tables: what each keeps, and its whole run."""

from __future__ import annotations

import collections
import itertools
import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import mixing, queries
from tidemark.runtime import load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def shingles(text: str, k: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def first_of_each_group(docs: list) -> set:
    """Ids that are least in their component of texts with a similarity of 0.8 or more, by comparing all pairs."""
    sets = {r.doc_id: shingles(r.text) for r in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def is_subsequence(part: list, whole: list) -> bool:
    it = iter(whole)
    return all(w in it for w in part)


def test_stages(spark, tmp_path):
    docs = load(spark, DATA, "documents")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        given, got = docs.collect(), out.collect()
        before, after = {r.doc_id: r for r in given}, {r.doc_id: r for r in got}
        assert after and set(after) <= set(before)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        if name == "toxicity":
            clean = {r.doc_id for r in load(spark, DATA, "labels").filter("toxic = 0").collect()}
            assert len(clean - set(after)) <= 0.05 * len(clean)
        elif name == "ngram_join":
            assert set(after) == first_of_each_group(given)
        elif name == "substring_dedup":
            seen: dict = {}
            for j in sorted(before):
                grams = {tuple(w) for w in zip(*(before[j].text.lower().split()[n:] for n in range(51)), strict=False)}
                repeats = any(g in seen for g in grams)
                if j in after:
                    assert is_subsequence(after[j].text.split(), before[j].text.split())
                    assert after[j].n_chars == len(after[j].text) and (repeats or after[j].text == before[j].text or len(after[j].text) < len(before[j].text))
                seen.update(dict.fromkeys(grams, j))
        elif name == "mix_sources":
            copies = collections.Counter(r.doc_id for r in got)
            taken = {r.doc_id: r.taken / r.size for r in mixing.mix(spark, docs).collect() if r.size}
            assert all(abs(copies[j] - t) <= 0.5 for j, t in taken.items())
        elif name == "pack":
            words, want = collections.Counter(), collections.Counter()
            for r in got:
                words[r.doc_id] += r.n_words
            for r in given:
                want[r.doc_id] += len(r.text.encode().split())
            assert words == want
            bins = collections.defaultdict(list)
            for r in got:
                bins[r.bin_id].append(r)
            assert all(sum(r.n_words for r in b) <= 2048 and len({r.source for r in b}) == len(b) == len({r.cluster for r in b}) for b in bins.values())
        docs = out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, out.fetchall()))


def test_run_gives_bins(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and all(r.bin_words <= 2048 for r in got)


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
