import inspect
import math
import os
import random
from collections import defaultdict

import pytest
from helpers import documents, edge_rows, sentence, words

from bytesieve.llm import near_copies as near_copies_module
from bytesieve.llm import op3_queries
from bytesieve.llm.components import components
from bytesieve.llm.near_copies import near_copies


def plain(rows, percent):
    """Components by comparing all pairs."""
    sets = defaultdict(set)
    for i, t in rows:
        w = words(t)
        sets[i] |= {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    a, b = find(x), find(y)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.id: (r.n, r.component) for r in df.collect() if r.id is not None}


def test_edges(spark):
    rows = edge_rows()
    out = near_copies(documents(spark, rows), percent=85)
    assert out.count() == len(rows)
    assert got(out) == plain([r for r in rows if r[0] is not None], 85)
    assert all(r.kept and r.component is None for r in out.where("id is null").collect())
    assert all(r.kept == (r.id == r.component) for r in out.where("id is not null").collect())


def test_groups_and_shared_passages(spark):
    """Long lists: a group of edited copies, and different texts that share a passage."""
    r = random.Random(5)
    base, passage = sentence(7, 80).split(), sentence(8, 30)
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(999)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, f"{sentence(100 + i, 25)} {passage} {sentence(500 + i, 25)}") for i in range(60)]
    out = near_copies(documents(spark, rows), percent=85, short=4, block=16)
    assert got(out) == plain(rows, 85)


def test_empty(spark):
    assert near_copies(documents(spark, [])).count() == 0
    assert near_copies(documents(spark, [(1, None)])).collect()[0].asDict() == {"id": 1, "n": 0, "component": 1, "kept": True}


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5), (None, 3), (7, 8)]
    r.shuffle(links)
    roots = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op3_queries.op3_near_copies(spark, sf_dir)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == plain(rows, 85)
    assert math.isfinite(out.count())


def test_chance_of_a_missed_pair():
    default = {n: p.default for n, p in inspect.signature(near_copies_module.near_copies).parameters.items()}
    k, listed = default["k"], default["listed"]
    for percent in (80, 85):
        s, cut = percent / 100, near_copies_module.least_estimate(percent, k)
        low = sum(math.comb(k, i) * s ** i * (1 - s) ** (k - i) for i in range(k + 1) if i / k < cut)
        assert (1 - s) ** listed + low <= 2e-7
        assert abs(near_copies_module.missed(percent, k, listed) - (1 - s) ** listed - low) < 1e-12
