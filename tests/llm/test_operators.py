"""Each operator against brute force on small tables, and on the odd ones: nulls, empty and long texts, repeats, clashes."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stepweave.llm import chat, components, embeddings, fingerprints, langid, mixing, packing, quality, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, row string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t", "de", None), (None, "a b c d e f", None, "t"), (5, long_text, "en", "s"), (6, long_text + " tail", "en", "t"), (7, "Wörter \U0001f600 ß", "de", "t"), (8, "12345 !!", "en", "t")]
    return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def test_fingerprints_against_exact_likeness(docs):
    got = {r.id: r for r in fingerprints.edited_pairs(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    shingles = lambda t: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))}
    off = []
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        off += [got[i].near_edited - len(a & b) / len(a | b), got[i].near_next - len(a & c) / len(a | c)]
    assert np.sqrt(np.mean(np.square(off))) < 0.05 and np.abs(off).max() < 0.2
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_odd(odd, none):
    out = {r.id: r for r in fingerprints.edited_pairs(odd).collect()}
    assert fingerprints.edited_pairs(odd).count() == odd.count() and set(out) == {1, 2, 3, 4, 5, 6, 7, 8, None} and out[2].fingerprint == out[3].fingerprint == out[4].fingerprint
    assert out[5].near_next < 0.2 and fingerprints.edited_pairs(none).count() == 0
    alone = odd.where("doc_id = 7")
    assert fingerprints.edited_pairs(alone).first().near_next == 1.0


def test_fingerprints_of_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "a longer text of this id"), (2, "the second one"), (3, "x y z"), (3, "x y z"), (None, "no id at all"), (None, None)]
    got = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    stands = {3: "x y z", 2: "the second one", 1: "a longer text of this id", None: "no id at all"}
    after = dict(zip(stands, [*list(stands)[1:], 3], strict=True))
    want = []
    for i, text in rows:
        text = text or ""
        n = len(text) // 3
        want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + stands[after[i]][:n]).encode()).hexdigest()))
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_packing_against_the_naive_choice(spark):
    """Every item, largest first, into the fullest bin that takes it; bins looked through one by one."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), f"s{rng.integers(4)}", str(rng.integers(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string")
    got = {r.id: (r.bin, r.start) for r in packing.pack(df, cluster_col="cluster", capacity=100, source_slots=2, shard_rows=10_000).collect()}
    items = [(len(t.split()), i, s, c) for i, t, s, c in rows]
    bins, want = [], {}
    for size, i, s, c in sorted(items, key=lambda x: (-x[0], x[1])):
        open_ = [(100 - b["used"], k) for k, b in enumerate(bins) if 100 - b["used"] >= size and b["sources"][s] < 2 and c not in b["clusters"]]
        k = min(open_)[1] if open_ else len(bins)
        if k == len(bins):
            bins.append({"used": 0, "sources": Counter(), "clusters": set()})
        want[i] = (k, bins[k]["used"])
        bins[k]["used"] += size
        bins[k]["sources"][s] += 1
        bins[k]["clusters"].add(c)
    assert got == want


def test_packing(docs, odd, none):
    for df, capacity in ((docs, 512), (odd, 1000)):
        out = packing.pack(df, capacity=capacity, source_slots=2, shard_rows=64).collect()
        sizes, sources, clusters = Counter(), Counter(), Counter()
        texts = [(r.doc_id, r.text, r.source) for r in df.collect()]
        by_id = {}
        for i, t, s in texts:
            by_id.setdefault(i, []).append((t, s))
        for r in out:
            sizes[r.shard, r.bin] += r.size
            if len(by_id[r.id]) == 1:
                t, s = by_id[r.id][0]
                sources[r.shard, r.bin, s] += 1
                clusters[r.shard, r.bin, t or ""] += 1
        assert max(sizes.values()) <= capacity and max(sources.values()) <= 2 and max(clusters.values()) == 1
        assert sum(r.size for r in out) == sum(len(words(t)) for _, t, _ in texts)
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # Of the rooms 4 and 5 the last item fits best into the first, but its cluster is there already.
    assert [p[0] for p in packing.best_fit([6, 5, 4], list("abc"), ["x", "y", "x"], 10, 1)] == [0, 1, 1]
    assert [p[0] for p in packing.best_fit([6, 5, 4], list("abc"), ["x", "y", "z"], 10, 1)] == [0, 1, 0]
    assert [p[0] for p in packing.best_fit([6, 5, 4], list("aba"), ["x", "y", "z"], 10, 1)] == [0, 1, 1]


def test_language(spark, docs, odd, none):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = langid.train(docs.where(~held))
    out = langid.with_language(docs, model).select("row.doc_id", "row.lang", "lang_pred", "score").collect()
    test = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.score >= model.floor for r in out if r.lang == r.lang_pred]) > 0.995
    labels = model.positions(np.frombuffer(b"theoneating", np.uint8)[:, None])
    assert labels.shape == (11, 1, len(model.languages)) and np.allclose(labels.sum(axis=-1), 1, atol=1e-5)
    got = {r.doc_id: r.lang_pred for r in langid.with_language(odd, model).select("row.doc_id", "lang_pred").collect() if r.doc_id}
    assert got[2] == got[3] == got[4] == got[8] == "und" and got[5] != "und"
    assert langid.train(none) is None and langid.with_language(none, None).count() == 0
    assert {r.lang_pred for r in langid.with_language(odd, None).collect()} == {"und"}


def slow_network(net, raw):
    """Label probabilities of each byte of one sequence, unit by unit."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w, n = net.weights, len(raw)
    states = {}
    for d in "fb":
        hidden, h = len(w[f"U{d}"]), [0.0] * len(w[f"U{d}"])
        for t in range(n) if d == "f" else reversed(range(n)):
            gate = lambda j, h=h, d=d, t=t: (w[f"W{d}"][raw[t], j], sum(h[i] * w[f"U{d}"][i, j] for i in range(len(h))))
            new = []
            for j in range(hidden):
                z, r = sigmoid(sum(gate(j))), sigmoid(sum(gate(hidden + j)))
                x, u = gate(2 * hidden + j)
                new.append(z * h[j] + (1 - z) * np.tanh(x + r * u))
            h = states[d, t] = new
    out = []
    for t in range(n):
        e = np.exp([w["c"][k] + sum(states[d, t][i] * w[f"O{d}"][i, k] for d in "fb" for i in range(len(states[d, t]))) for k in range(len(net.languages))])
        out.append(e / e.sum())
    return np.array(out)


def test_network_against_loops():
    net = langid.ByteGRU.fresh(["a", "b", "c"], 3, 2)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    raw = np.frombuffer("wörd one".encode(), np.uint8)
    assert np.allclose(net.positions(raw[:, None])[:, 0], slow_network(net, raw))
    # Windows of a long text: each letter once, labelled as in its own window, whatever word it stands in.
    text = ("ab é, " * 60).encode()
    want, counted = np.zeros(3), 0
    for start in range(0, len(text), langid.STRIDE):
        window = b"".join(text[k : k + 1] if 0 <= k < len(text) else b" " for k in range(start - langid.EDGE, start - langid.EDGE + langid.SPAN))
        labels = slow_network(net, np.frombuffer(window, np.uint8))
        for k in range(start, min(start + langid.STRIDE, len(text))):
            if text[k] >= 128 or chr(text[k]).isalpha():
                want, counted = want + labels[k - start + langid.EDGE], counted + 1
    assert np.allclose(net.pooled([b"", text, b"1 2"]), [[0] * 3, want / counted, [0] * 3])
    # What stands in another word changes a label: the state crosses blanks.
    assert not np.allclose(net.positions(np.frombuffer(b"ab cd", np.uint8)[:, None])[-1], net.positions(np.frombuffer(b"xb cd", np.uint8)[:, None])[-1])


def test_a_letter_is_never_undetermined(spark):
    net = langid.ByteGRU.fresh(["a", "b"], 3, 1)
    texts = ["." * 23 + "é", "." * 127 + "é", "语", "12 ½", "", None, "🙂"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(rows, net).select("row.doc_id", "lang_pred", "score").collect()}
    assert [out[k][0] == "und" for k in range(7)] == [False, False, False, True, True, True, True] and all((s > 0) == (p != "und") for p, s in out.values())


def test_network_gradients():
    net = langid.ByteGRU.fresh(["a", "b"], 3, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes, target = np.array([[1, 2], [3, 1], [2, 2]]), np.array([0, 1])
    loss = lambda: -np.mean(np.log(net.positions(codes)[:, np.arange(2), target]))
    grads = net.gradients(codes, target)
    for k, weight in net.weights.items():
        for spot in np.ndindex(weight[:4].shape):
            kept, step = weight[spot], 1e-5
            weight[spot] = kept + step
            up = loss()
            weight[spot] = kept - step
            down = loss()
            weight[spot] = kept
            assert abs((up - down) / (2 * step) - grads[k][spot]) < 1e-7


class KneserNey:
    """Interpolated modified Kneser-Ney of order five, written out over dictionaries of tuples."""

    def __init__(self, texts):
        self.counts = {5: Counter(g for t in texts for g in self.grams(t))}
        for order in (4, 3, 2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discounts, self.total, self.free = {}, Counter(), Counter()
        for order, counts in self.counts.items():
            n = Counter(min(c, 5) for c in counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else d for k, d in ((1, 0.5), (2, 0.75), (3, 0.9))]
            self.discounts[order] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]
            for g, c in counts.items():
                self.total[g[:-1], order] += c
                self.free[g[:-1], order] += self.discounts[order][min(c, 3) - 1]

    @staticmethod
    def grams(text):
        out, before = [], [0] * 4
        for c in (text or "") + " ":
            k = quality._class(ord(c)) if ord(c) < 0x10000 else quality._OTHERS + ord(c) % (256 - quality._OTHERS)
            if k or before[-1]:
                out.append((*before, k))
                before = [*before[1:], k]
        return out

    def log_p(self, gram):
        p = 1 / 256
        for order in range(1, 6):
            g = gram[-order:]
            if self.total[g[:-1], order]:
                c = self.counts[order][g]
                p = ((c - self.discounts[order][min(c, 3) - 1] if c else 0) + self.free[g[:-1], order] * p) / self.total[g[:-1], order]
        return np.log(p)


def test_classes_tell_scripts_apart():
    for alphabet in ("αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"):
        assert len({quality._class(ord(c)) for c in alphabet}) == len(alphabet)


def test_quality_against_brute_force(spark, docs, odd, none):
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    got = {r.id: r for r in quality.score_quality(docs, trusted).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = KneserNey([texts[i] for i, r in got.items() if r.trusted and not r.held_out])
    assert any(r.held_out for r in got.values()) and abs(sum(np.exp(model.log_p((1, 2, 3, 4, w))) for w in range(256)) - 1) < 1e-9
    for i, text in sorted(texts.items())[:60]:
        want = np.exp(-np.mean([model.log_p(g) for g in model.grams(text)]))
        assert abs(got[i].perplexity - want) < 1e-6 * want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[i].keep for i, q in labels.items() if q == 1]
    bad = [got[i].keep for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3, (np.mean(good), np.mean(bad))  # 3 of 11 here
    odd_out = quality.score_quality(odd, trusted).collect()
    assert len(odd_out) == 10 and not any(r.keep for r in odd_out if r.n_grams == 0)
    assert quality.score_quality(none, trusted).count() == 0 and quality.score_quality(odd, trusted.limit(0)).where("keep").count() == 7


def slow_simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_against_brute_force(docs, odd, none):
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = [slow_simhash(texts[r.id]) for r in rows]
    assert fps == [r.fp % 2**64 for r in rows]
    root = roots_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [r.component_id for r in rows] == [rows[k].id for k in root]
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 10 and {r.component_id for r in out if r.fp == 0} == {2} and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in out if r.id is None} == {1}


def test_simhash_buckets_beyond_a_tile(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20)
    fps = np.unique(np.concatenate([base ^ (1 << rng.integers(0, 30, 20)) ^ (1 << rng.integers(0, 30, 20)) for _ in range(30)]))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), tile=8)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    want = roots_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3])
    assert [roots.get(int(x), int(x)) for x in fps] == [int(fps[k]) for k in want]


def test_thresholds_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    groups = simhash.group_bits(500, x.T @ x, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum(simhash.allocate(500, x.T @ x, groups, 3)) == 0 and sum(simhash.allocate(500, x.T @ x, simhash.group_bits(500, x.T @ x, 3), 3)) == 1


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_substrings_against_brute_force(docs, odd, none):
    for df in (docs, odd):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        seen = Counter(tuple(words(t)[k : k + 35]) for _, t in texts for k in range(len(words(t)) - 34))
        want = []
        for i, t in texts:
            w = words(t)
            gone = np.zeros(len(w), bool)
            for k in range(len(w) - 34):
                if seen[tuple(w[k : k + 35])] > 1:
                    gone[k : k + 35] = True
            want.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
        got = [(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.remove_repeats(none).count() == 0


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        first, second = (sorted(map(tuple, mixing.mix(df, bucket_rows=8, fan=2).collect()), key=repr) for _ in range(2))
        assert first == second and len(first) == df.count()
        rows = mixing.mix(df, bucket_rows=8, fan=2).collect()
        largest = max(r.size for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.source, []).append(r)
        sizes = {s: sum(r.size for r in own) for s, own in by.items()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        left, goal, want = 1.5 * sum(sizes.values()), dict(weight), {}
        while goal:
            share = left / sum(goal.values())
            over = [s for s in goal if share * goal[s] > 2 * sizes[s]]
            if not over:
                want |= {s: share * goal[s] for s in goal}
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                left -= want[s]
                del goal[s]
        for s, own in by.items():
            assert abs(own[0].target - want[s]) < 1e-6 * max(1, want[s])
            assert abs(sum(r.copies * r.size for r in own) - want[s]) <= largest and max(r.copies for r in own) <= 2
        assert mixing.take_mix(df, bucket_rows=8, fan=2).count() == sum(r.copies for r in rows)
    assert mixing.mix(none).count() == 0


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|end|>", "\\l \\e \\p \\\\ <|+|> |> é\U0001f600", "", None]
    rows = [(1, k, role, t) for k, (role, t) in enumerate([(r, t) for r in ("user", "assistant", "assistant", None) for t in tricky])]
    rows += [(2, 0, "as<|s|>", "x"), (None, 0, "user", "y"), (2, 0, "as<|s|>", "x"), (2, None, "user", "first")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in got[1].t] == [(r or "", t or "") for _, _, r, t in rows if _ is not None][: len(got[1].t)] and len(got[1].t) == 20
    assert got[1].loss == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert [t.text for t in got[2].t] == ["first", "x", "x"] and got[None].t[0].text == "y"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_ties_go_by_the_raw_text(spark):
    rows = [(1, 3, "user", t) for t in ("A", "<", "|", "\\", "a")] + [(1, None, "user", "none"), (None, 1, "user", "x"), (None, 1, "user", "x"), (None, 2, "b", None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert [t.text for r in out if r.conv_id == 1 for t in r.t] == ["none", *sorted(["A", "<", "|", "\\", "a"])]
    assert sorted((t.role, t.text) for r in out if r.conv_id is None for t in r.t) == [("b", ""), ("user", "x"), ("user", "x")] and len(out) == 2


def test_chat_merges_and_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns)
    assert out.first().formatted == "<|user|>a<|+|>b<|end|><|assistant|>c<|end|>"
    plan = out._jdf.queryExecution().toString() + fingerprints.edited_pairs(turns.select(F.col("conv_id").alias("doc_id"), "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_toxicity(spark, docs, odd, none):
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    table = spark.createDataFrame([(k, ("you total moron, go away " if k % 5 == 0 else "have a pleasant quiet day ") + f"number{k} and more plain words") for k in range(200)], "doc_id long, text string")
    logp = toxicity.language_model(table)
    model = toxicity.learn(table, labels, logp)
    hidden = ["M0R0N", "m.o.r.o.n", "m o r o n", "moroooon", "m*ron", "a m0r0n!"]
    clean = ["a pleasant day", "", None, "1024 $ 5!", "x" * 50_000]
    test = spark.createDataFrame([(k, t, "c") for k, t in enumerate(hidden + clean)], "doc_id long, text string, score string")
    out = [r.predicted for r in sorted(toxicity.with_toxicity(test, logp, model).select("row.doc_id", "predicted").collect())]
    assert out == [1] * len(hidden) + [0] * len(clean)
    assert toxicity.Decoder(logp).restored_text("You m0r0n") == "you moron"
    assert toxicity.with_toxicity(odd, logp, model).count() == 10 and toxicity.with_toxicity(none, toxicity.language_model(none), toxicity.learn(none, labels, logp)).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(scale=0.12, size=(100, 16))
    rows = [(k, [float(v) for v in vec], 1) for k, vec in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, None), (303, [None] + [1.0] * 15, 1), (None, rows[0][1], 1), (7, rows[7][1], 2), (304, [], 1), (305, [float("inf")] * 16, 1), (306, [v * 1e200 for v in rows[9][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = Counter(map(tuple, embeddings.near_duplicates(df, tile=64, lead=4).collect()))
    good = [k for k, r in enumerate(rows) if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    unit = np.array([np.array(rows[k][1]) / np.max(np.abs(rows[k][1])) for k in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    root = roots_of(len(rows), [(good[a], good[b]) for a in range(len(good)) for b in range(a) if near[a, b]])
    members = {}
    for k, r in enumerate(root):
        members.setdefault(r, []).append(rows[k][0])
    least = {r: min((m for m in own if m is not None), default=None) for r, own in members.items()}
    links = dict(zip(good, near.sum(axis=1) - 1, strict=True))
    want = Counter((r[0], int(links.get(k, 0)), least[root[k]], r[0] == least[root[k]]) for k, r in enumerate(rows))
    assert got == want and embeddings.near_duplicates(df.limit(0)).count() == 0
