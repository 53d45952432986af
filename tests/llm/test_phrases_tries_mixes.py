"""Collocations, the conversation trie and the source mix against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import compare, connect
from helpers import ASCII_LOW

from bytesieve.llm import catalog, mixing
from bytesieve.llm.collocations import collocations
from bytesieve.llm.prefix_trie import CUT, ZFastTrie, conversation_trie, two_fattest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_collocations", "op12_prefix_trie", "op13_mixing"])
def test_against_sql(spark, name):
    message, *_ = compare(spark, connect(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert not message


# ------------------------------------------------------------ collocations

def plain_collocations(rows, least, percent=100, first=None):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + k] for p, a in own.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                   if 100 * a >= percent * counts[p[i:i + k]]}
        best = []
        for p, a in own.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in dropped:
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got_collocations(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def phrase_rows(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [r.choice("aeiou") + r.choice("bcdfgäß日") + r.choice("xyz") for _ in range(12)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            words[len(words) // 2:len(words) // 2] = "Strong Tea with Cold milk".split()
        text = "".join(w + r.choice([" ", "  ", "\t", " ", " ", ". ", ", ", "\n", "\x0b", "?! "]) for w in words)
        rows.append((r.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("xx", None), ("en", " \t\n"), ("und", "strong tea with cold milk"),
                   ("en", "strong tea " * 3000), ("de", "ab" * 5000)]


def documents_of(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", 7) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, n int")


@pytest.mark.parametrize("bits, filter_bits", [(64, 27), (8, 27), (3, 27), (64, 6)])
def test_collocations(spark, bits, filter_bits):
    """Fingerprints of 8 and 3 bits collide all the time, a filter of 64 bits lets all pass: the result stays."""
    rows = phrase_rows()
    df = documents_of(spark, rows).repartition(5)
    got = got_collocations(collocations(df, least=5, first=None, bits=bits, filter_bits=filter_bits))
    assert got == plain_collocations(rows, 5) and len(got) > 30


def test_collocations_ranks_and_cover(spark):
    rows = phrase_rows(2)
    df = documents_of(spark, rows)
    assert got_collocations(collocations(df, least=5, percent=60, first=7)) == plain_collocations(rows, 5, 60, 7)
    assert collocations(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")
    assert collocations(none).count() == 0


# ------------------------------------------------------------ conversations

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k)).encode()).hexdigest())
                  for k, m in list(members.items()))


def got_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversation_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 900), n):
        turns = r.randrange(1, 9)
        shared = r.random() < 0.5
        for t in range(turns):
            text = ("same %d" % (t if t < 5 else r.randrange(2))) if shared else r.choice(["aä", "b", "日本", "dd"])
            rows.append((c, t, r.choice(["user", "user", None, "bot"]) if not shared else "user", text))
    rows += [(None, 1, "user", "x"), (1000, None, None, None), (1000, 5, "user", "x" * 4000), (1000, 5, "user", "x" * 4000),
             (1001, None, "user", None), (-7, 0, "user", "a"), (-107, 0, "user", "a"), (-100, 3, "user", "a")]
    r.shuffle(rows)
    return rows


def conversations_of(spark, rows):
    return spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, depth int, name string")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversation_rows(seed)
    assert got_trie(conversation_trie(conversations_of(spark, rows).repartition(4))) == plain_trie(rows)


def test_trie_long_conversations(spark):
    """Conversations longer than a string, that part, end or go on at a cut, and far longer ones."""
    rows = []
    for c, turns in ((6, CUT), (7, CUT + 1), (8, 2 * CUT + 40), (9, CUT + 60), (10, CUT - 1), (11, 3), (12, CUT), (13, 2 * CUT)):
        part = CUT + 30 if c == 9 else CUT - 5 if c == 13 else 10 ** 6
        rows += [(c, t, "user", f"t{t}" if t < part else f"{c} {t}") for t in range(turns)]
    got, want = got_trie(conversation_trie(conversations_of(spark, rows))), plain_trie(rows)
    assert got == want


def test_trie_empty(spark):
    assert conversation_trie(conversations_of(spark, []).limit(0)).count() == 0
    # h of 3 is more than its one turn and nobody lends
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "a")]
    assert got_trie(conversation_trie(conversations_of(spark, rows))) == plain_trie(rows)


def test_z_fast_trie_finds_exit_nodes():
    """Names of 16 bytes; the exit node and the shared length of a string agree with a plain comparison."""
    assert [two_fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (6, 7), (5, 12), (8, 12))] == [1, 4, 6, 7, 8, 12]
    r = random.Random(3)

    def items(word):
        return b"".join(hashlib.md5(word[:i + 1].encode()).digest() + bytes(8) for i in range(len(word)))

    trie, known = ZFastTrie(), []
    for _ in range(400):
        word = "".join(r.choice("ab") for _ in range(r.randrange(0, 40)))
        if known and r.random() < 0.5:
            word = (r.choice(known) + word)[:r.randrange(1, 60)]
        before = max((len(os.path.commonprefix([word, k])) for k in known), default=0)
        trie.start.append(0), trie.items.append(items(word))
        assert trie.exit_node(len(trie.start) - 1, len(word))[1] == before
        trie.insert(0, items(word))
        known.append(word)
    assert all(low < high for low, high in zip(trie.low, trie.high, strict=True))
    assert len(trie.handles) == len(trie.edges) == len(trie.low) < 2 * len(set(known))


# ------------------------------------------------------------ mixes

def plain_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Shares by rounds of resharing, as fractions of floats."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), percent / 100 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mix_rows(seed, n=500):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 40))),
             r.choice(["a", "a", "a", "a", "ä", "b", "Z", None, "c%d" % r.randrange(4)])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (n + 2, " \t\x0b\n ", None), (n + 3, "x " * 50_000, "b"), (5, "again", "a"),
                   (5, "again", "a"), (None, "no id", "a"), (None, "no id", "a"), (n + 4, "\x1cone\x85two three\x0dfour ", "Z")]


def documents_to_mix(spark, rows):
    return spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, size int, key string")


def mixed(df):
    return sorted((str(r.id), r.source or "", r.size, r.source_size, r.target, r.taken) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    df = documents_to_mix(spark, rows)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert mixed(mixing.mix(df)) == mixed(mixing.mix(df.repartition(7)))


def test_mix_rare_words(spark):
    """One source, none, and sources that fill up one after the other."""
    assert mixing.mix(documents_to_mix(spark, []).limit(0)).count() == 0
    empty = mixing.mix(documents_to_mix(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    rows = [(i, "w " * (2 ** (i % 12)), "s%02d" % (i % 12)) for i in range(120)]
    got = mixing.mix(documents_to_mix(spark, rows)).collect()
    want = plain_targets({"s%02d" % k: 10 * 2 ** k for k in range(12)})
    assert all(abs(r.target - want[r.source]) < 1e-6 * r.target for r in got)
    assert {s for s in want if want[s] == 2 * 10 * 2 ** int(s[1:])}  # some are full


def test_mixed_texts(spark):
    rows = [(i, "  one two\tthree  four five six " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)]
    df = documents_to_mix(spark, rows)
    plan = mixing.mix(df)
    words = defaultdict(int)
    for r in mixing.mixed_texts(df, plan).collect():
        words[r.id] += len(r.text.split())
        assert dict((i, t) for i, t, _ in rows)[r.id].startswith(r.text)
    assert words == {r.id: r.taken for r in plan.collect() if r.taken}
