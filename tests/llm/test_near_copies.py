"""Near copies, links of fingerprints that exact likeness confirms, against brute force: few texts and large groups."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stepweave.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def windows(text):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def shingles(text):
    return set(windows(text))


def groups(texts):
    """Sets of indexes of texts that links of Jaccard similarity 0.8 or more connect."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    found = {}
    for k, r in enumerate(root):
        found.setdefault(r, set()).add(k)
    return sorted(map(sorted, found.values()))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()), key=repr)


def near_texts(rng):
    """Texts of the smallest table, a group of near copies with up to five words changed, and odd ones."""
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()]
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(70):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts + ["", None, " \n", "Two words", "two  words", "two others"]


@pytest.mark.parametrize("seed", [48, 4])
def test_stage_against_brute_force(spark, seed):
    texts = near_texts(random.Random(seed))
    want = groups(texts)
    assert kept(spark, [(k, t, "en", "s", None) for k, t in enumerate(texts)]) == sorted(((g[0], texts[g[0]]) for g in want), key=repr)
    assert any(1 < len(g) for g in want)


def components(spark, texts, **how):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.node: r.root for r in simhash.near_components(docs, **how).collect()}
    nodes = [r[0] for r in docs.select(simhash.text_class(F.col("text"))).collect()]
    by_root = {}
    for k, node in enumerate(nodes):
        by_root.setdefault(found.get(node, node), []).append(k)
    return sorted(by_root.values())


@pytest.mark.parametrize("how", [{"tau": None}, {"far": 128}, {"tile": 16}])
def test_every_plan_finds_the_same_components(spark, how):
    """With and without the search of fingerprints and the check of bits, and with buckets in tiles."""
    texts = near_texts(random.Random(7))
    assert components(spark, texts, **how) == groups(texts)


def test_pairs_just_above_the_limit(spark):
    """Texts that are the first four fifths of another, and texts with words changed, of several lengths."""
    rng, texts = random.Random(3), []
    for k in range(600):
        length = (8, 30, 60, 200)[k % 4]
        words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        texts.append(" ".join(words))
        if k % 3:
            texts.append(" ".join(words[: -(-4 * (length - 4) // 5) + 4]))
        else:
            for at in rng.sample(range(length), max(1, length // 50)):
                words[at] = "x"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    near = [[k, k + 1] for k in range(0, len(texts), 2) if 5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1])]
    assert len(near) > 350
    assert [g for g in components(spark, texts, tau=None) if len(g) > 1] == near


def test_hashes_of_blocks_tell_shingles_apart():
    """Slices of a batch, blank texts among them: equal shingles have equal hashes, others don't, and majorities are those of each text."""
    texts = near_texts(random.Random(2)) + [" \x0b\u00c4  \u00d6a\x0cB \x1c \x85 \u2003 C\r\nd", "\t\x0b", "Z"]
    batch, of, back = pa.array(texts), {}, {}
    for at in (0, 37, 74, 111, 148, 185):
        hashes, n = simhash._combined(batch.slice(at, 37), 5)
        prints = simhash._majorities(hashes, n)
        for text, own, fp in zip(texts[at : at + 37], np.split(hashes, np.cumsum(n)[:-1]), prints, strict=True):
            assert len(own) == len(windows(text)) and simhash._majority(own) == int(fp)
            for w, x in zip(windows(text), own.tolist(), strict=True):
                assert of.setdefault(w, x) == x and back.setdefault(x, w) == w
    assert len(of) > 5000


def test_a_dense_bucket_gives_a_forest_and_no_repeats(spark):
    """Sets of texts that share keys come once, and of a bucket no more pairs than texts are sent on, however alike these are."""
    rows = [(k, 5, 10, 9, [1, 2, 3, 100 + k]) for k in range(50)] + [(k, 5 << 40, 10, 2**60 - 1, [1, 200 + k]) for k in range(50, 60)]
    classes = spark.createDataFrame(rows, "node long, fp long, n int, further long, keys array<long>")
    buckets = simhash._buckets(classes)
    held = Counter(r.held for r in buckets.collect())
    assert held == {60: 60, 50: 50}
    links = [tuple(r) for r in simhash._candidates(buckets, classes, 2048, 6, 0.8).collect()]
    reach = {frozenset(g) for g in merged(range(60), links)}
    assert len(links) == 49 + 9 + 49 and reach == {frozenset(range(50)), frozenset(range(50, 60))}


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, 1 << simhash.CELL_BITS)
    for _ in range(2000):
        n = int(rng.integers(1, 40))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        x, y = pool[:n], np.sort(np.concatenate([pool[int(rng.integers(0, n)) : n], pool[n : n + int(rng.integers(0, 1 + n // 4))]]))
        shared = len(np.intersect1d(x, y))
        if 5 * shared >= 4 * (len(x) + len(y) - shared):
            assert len(np.intersect1d(simhash.prefix(x, counts, 0.8), simhash.prefix(y, counts, 0.8)))


def test_withheld_links_are_found_between_parts(spark, monkeypatch):
    """Of a dense group only a forest is sent on, and its nodes; parts of a group are joined tile by tile."""
    monkeypatch.setattr(simhash, "PARTS", 7)
    rng = np.random.default_rng(5)
    fps = sorted({int(x) for x in 12345 ^ (1 << rng.integers(0, 60, 400)) ^ (1 << rng.integers(0, 60, 400))})
    rows = spark.createDataFrame([(k, fp, 10) for k, fp in enumerate(fps)], "node long, fp long, n int")
    links = [tuple(r) for r in simhash.near_links(rows, 6, least=0.8).collect()]
    near = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 6}
    assert {(min(x), max(x)) for x in links if x[0] != x[1]} <= near and any(u == v for u, v in links)
    rows = spark.createDataFrame([(0, k, fp, 10, 0, k % 9, list(range(k % 3, k % 3 + 10))) for k, fp in enumerate(fps[:40])], "grp long, node long, fp long, n int, further long, root long, els array<long>")
    got = [tuple(r) for r in simhash._between_parts(rows, 6, 0.8).collect()]
    alike = {(a, b) for a, b in near if b < 40 and a % 9 != b % 9 and abs(a % 3 - b % 3) < 2}
    assert got and {(min(x), max(x)) for x in got} <= alike
    reach = {frozenset(g) for g in merged(range(9), [(u % 9, v % 9) for u, v in got])}
    assert reach == {frozenset(g) for g in merged(range(9), [(u % 9, v % 9) for u, v in alike])}


def merged(nodes, pairs):
    sets = [{n} for n in nodes]
    for a, b in pairs:
        hit = [s for s in sets if a in s or b in s]
        sets = [s for s in sets if s not in hit] + [set().union(*hit)]
    return sets


def test_all_links_of_a_table_are_found(spark):
    """The components of a whole table are those of exact likeness, found by counting shared shingles."""
    texts = sorted({r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '[^ \\n\\t]')").fetchall()})
    sets, holders, pairs = [shingles(t) for t in texts], {}, []
    for k, own in enumerate(sets):
        shared = Counter(j for x in own for j in holders.get(x, ()))
        pairs += [(j, k) for j, n in shared.items() if 5 * n >= 4 * (len(own) + len(sets[j]) - n)]
        for x in own:
            holders.setdefault(x, []).append(k)
    want = sorted(sorted(s) for s in merged(sorted({x for p in pairs for x in p}), pairs))
    assert want and [g for g in components(spark, texts) if len(g) > 1] == want


def test_stage_links_between_080_and_096(spark):
    words = [f"w{k}" for k in range(200)]
    near = " ".join([*words[:50], "x", *words[51:100], "y", *words[101:]])  # Jaccard 186 / 206
    far = " ".join("z" if k % 20 == 7 else w for k, w in enumerate(words))
    assert [i for i, _ in kept(spark, [(1, " ".join(words), "en", "s", 1), (2, near, "en", "s", 1), (3, far, "en", "s", 1)])] == [1, 3]


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_no_sequence_holds_two_near_copies(spark, tmp_path, stage):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join("x" if i == 10 * k else w for i, w in enumerate(words)) for k in range(6)] + ["a short text", "a short text", "another one"]
    docs = spark.createDataFrame([(k, t, "en", f"s{k}", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = (queries.op2_best_fit(spark, str(tmp_path)) if stage == "query" else cp.pack_sequences(spark, docs, SF)).collect()
    bins = {r.doc_id: (r.shard, r.bin) for r in out}
    for g in groups(texts):
        assert len({bins[k] for k in g}) == len(g)
    assert len(out) == len(texts) and max(map(len, groups(texts))) == 6


def test_rows_of_one_id_and_of_none(spark):
    rows = [(1, "one quite different text about the sea", "en", "s", 1), (1, "and a second one about high mountains", "en", "s", 1), (1, "one quite different text about the sea", "en", "s", 1)]
    rows += [(None, "no id but copies all the same here", "en", "s", 1)] * 3 + [(None, "a copy of what has an id", "en", "s", 1), (7, "a copy of what has an id", "en", "s", 1)]
    want = sorted({r[:2] for r in rows if r[:2] != (None, "a copy of what has an id")}, key=repr)
    assert kept(spark, rows) == want


def test_alike_texts_whose_fingerprints_differ_widely(spark):
    """Four of five shingles, Jaccard 0.8, and 46 of 128 bits of the fingerprints apart."""
    words = "w948765 w837932 w402184 w837373 w840204 w29602 w94103 w150570 w686027".split()
    texts = [" ".join(words), " ".join(words[:8]), " ".join(words[:7])]
    assert groups(texts) == [[0, 1], [2]] and components(spark, texts) == [[0, 1], [2]]


def test_large_groups_are_split_and_lose_no_link(spark, monkeypatch):
    """Long texts with passages in common are one group by their rare shingles, and by longer marks none."""
    monkeypatch.setattr(simhash, "PARTS", 7)
    texts, before, after = near_texts(random.Random(9)), [], []
    common = [f"c{k}" for k in range(400)]
    texts += [" ".join([f"u{k}_{i}" for i in range(1600)] + common) for k in range(12)]
    split = simhash._split
    sizes = lambda info: sorted(r["count"] for r in info.groupBy("grp").count().collect())

    def shown(texts, info, *args):
        out = split(texts, info, *args)
        before.extend(sizes(info))
        after.extend(sizes(out))
        return out

    monkeypatch.setattr(simhash, "_split", shown)
    assert components(spark, texts) == groups(texts)
    assert max(before) > 7 and after


def test_marks_rule_out_no_alike_sets():
    """Sets at the limit and above are never ruled out, of whatever size; most others are."""
    rng, ruled = np.random.default_rng(6), []
    for n in [*range(1, 60), 300, 2000]:
        pool = np.unique(rng.integers(0, 1 << 63, 4 * n).astype(np.uint64))
        for shared in (n, n - n // 10, n - n // 9, n // 2, 0):
            x, y = pool[:n], np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
            alike = 5 * shared >= 4 * (n + len(y) - shared)
            for words in (simhash.MARKS, simhash.LONG_MARKS):
                held = simhash._may_be_alike(None, None, simhash._marks([x, y], words), np.array([n, len(y)]), np.array([0]), np.array([1]), 128, 0.8)[0]
                assert held or not alike
                ruled += [not held] if not alike else []
    assert sum(ruled) > 0.7 * len(ruled)
