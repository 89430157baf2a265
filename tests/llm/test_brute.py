"""Operators that SQL can't express, against plain versions."""

import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearvote.llm import decontaminate, exact_dedup, line_dedup, order_minhash, packing, pii, quality, sharding, substring_dedup, toxicity
from nearvote.llm.queries import QUERIES, tokenizer_path
from nearvote.llm.text import ALNUM, SPACED, Words, rolling

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


# --- words and hashes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ09 \t\n\x0b.,-_üß漢\x1f"), max_size=6))
def test_words_are_split_and_hashed_alike(batch):
    for values, pattern, lower in ((ALNUM, WORD, True), (SPACED, re.compile(r"[^ \t-\r]+"), False)):
        w = Words(batch, values)
        want = [pattern.findall(t.translate(ASCII_LOWER) if lower else t) for t in batch]
        assert w.counts.tolist()[: len(batch)] == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        by_hash = defaultdict(set)
        for h, x in zip(w.hashes.tolist(), flat, strict=True):
            by_hash[h].add(x)
        assert len(by_hash) == len(set(flat)) and all(len(s) == 1 for s in by_hash.values())


def test_rolling_depends_on_words_alone():
    a, b = Words(["x y z w"], SPACED), Words(["q x y z"], SPACED)
    assert rolling(a.hashes, 3)[0] == rolling(b.hashes, 3)[1] != rolling(a.hashes, 3)[1]


# --- personal data


def _plain_base(x):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]
    return [(s, e, pii.KINDS[k]) for s, e, k in sorted(out, key=lambda y: (y[0], y[2], y[1]))]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.125 +-()\n%é", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == _plain_base(text)


def test_base_spans_of_corpus(texts):
    for t in texts.values():
        assert pii.base_spans(t) == _plain_base(t)


def test_long_runs_are_linear():
    for unit in ("1", "a", "1.", "@", "+1", "a@"):
        pii.base_spans(unit * 200_000)


def test_field_adds_mentions_and_keeps_base():
    field = pii.trained()
    text = "call +1 (658) 555-4270 or later 658.555.4270 or (658) 555-4270, not version 2.0 on 2024-01-02"
    base, every = pii.spans(text, field)
    assert [text[s:e] for s, e, _ in base] == ["+1 (658) 555-4270"]
    assert set(base) <= set(every)
    assert [text[s:e] for s, e, _ in every] == ["+1 (658) 555-4270", "658.555.4270", "(658) 555-4270"]
    for clean in ("a word, and 12 others at 10:30", "order 12345678901234 of 2023-10-11", "Version 2.0 of token 337362c5e9d09584625daaf3132186228c959e75"):
        assert pii.spans(clean, field) == ([], [])


def test_repeats_lend_each_other_evidence():
    field = pii.trained()
    seq = pii.tokens("x 5554270 y 555-4270")
    alone = field.marginals(seq[:1], np.array([-1]))[0]
    seen = field.marginals(seq, np.array([-1, 4]))[0]
    assert seen[4] > alone[4]


# --- classifiers


def _enumerated(field, seq, observed):
    """Marginals of the field by summing over all labellings."""
    score = pii._features(seq) @ field.unary
    chain, skip = pii._edges(seq)
    n, k = len(seq), len(pii.LABELS)
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if all(o < 0 or o == x for o, x in zip(observed, labels, strict=True)):
            total = sum(score[i, x] for i, x in enumerate(labels))
            total += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
            for i, x in enumerate(labels):
                out[i, x] += np.exp(total)
    return out / out.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    """Exact where edges form a tree; where they form a cycle, with messages that go round, the likeliest labels are the same."""
    field = pii.trained()
    trees = ["call 555-123-4567 or (555) 123-4567", "x@y.org and 12 and X@Y.ORG", "4111 1111 apples", "5551234 5551234", "no 17 or 2031-02-03 1"]
    for text in trees:
        seq = pii.tokens(text)
        observed = np.full(len(seq), -1)
        if len(pii._edges(seq)[0]) + len(pii._edges(seq)[1]) < len(seq):
            assert np.allclose(field.marginals(seq, observed), _enumerated(field, seq, observed), atol=2e-3), text
    seq = pii.tokens("4111.1111.1111.1111 then 4111 1111 1111 1111")
    observed = np.full(len(seq), -1)
    observed[0] = 3
    got, want = field.marginals(seq, observed), _enumerated(field, seq, observed)
    assert (got.argmax(1) == want.argmax(1)).all()


def test_spaced_groups_share_a_key():
    seq = pii.tokens("card 4111 1111 1111 1111, later 4111.1111.1111.1111 and 12 apples")
    keys = pii._keys(seq)
    assert keys[0] == keys[3] == keys[4] == "1111111" and keys[5] is None


def _auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def _corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["re", "th", "on", "er", "an", "he", "in", "ti", "sh", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    bad = ["zzgrob", "kwarn", "plimf"]
    out, y = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", "er", "an"]))
        out.append(" ".join(words))
        y.append(int(toxic))
    return out, np.array(y)


def test_network_learns_words_and_stems():
    x, y = _corpus(600, 1)
    held, truth = _corpus(200, 2)
    net = toxicity.train(x, y)
    scores = net.score(held)
    assert _auc(truth, scores) > 0.98
    assert ((scores >= 0.7) == truth).mean() > 0.95


def test_gradients_of_the_network():
    x, y = _corpus(12, 3)
    net = toxicity.Network(*[np.random.default_rng(i).standard_normal((1 << toxicity.BITS, toxicity.WIDTH)).astype(np.float32) * 0.1 for i in range(2)], prior=0.0)
    v = toxicity.Vocabulary(x)
    windows, text = v.windows()
    target, weight = y[text].astype(np.float32), np.ones(len(text), np.float32)
    inputs, values = net.inputs(v)
    g = net.gradients(inputs, values, v, windows, target, weight)

    def loss():
        score = net.forward(net.inputs(v)[0], windows)[0].astype(float)
        return float(np.log1p(np.exp(-np.where(target > 0, score, -score))).sum())

    for name in ("wf", "rb", "v", "o", "u", "cf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=0.02)


def test_held_out_toxicity(spark):
    """Through the query itself, on documents whose labels it never saw."""
    out = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    right, flagged = ((out["predicted"] == 1) & (out["toxic"] == 1)).sum(), (out["predicted"] == 1).sum()
    assert right / max(1, flagged) >= 0.9 and right / (out["toxic"] == 1).sum() >= 0.7
    assert _auc(out["toxic"].to_numpy(), out["score"].to_numpy()) > 0.9


def test_training_rows_are_bounded_in_number_and_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * (10_000 if i == 3 else 5)) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    held = lambda **kw: toxicity.fit(docs, labels, F.lit(True), **kw)
    # document 3 doesn't fit, the others do: the same network as without it
    a, b = held(most_bytes=5_000), toxicity.fit(docs.where("doc_id != 3"), labels, F.lit(True))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert held(most_bytes=1).constant == 0.5


def test_every_word_is_in_a_window():
    v = toxicity.Vocabulary(["a b c", "", " ".join(map(str, range(100)))])
    windows, text = v.windows()
    for i in (0, 2):
        words = v.index[v.words.first[i] : v.words.last[i]]
        assert set(words) <= set(windows[text == i].ravel())
    assert 1 not in text


def test_additive_model_finds_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert (0, 1) in [tuple(sorted(p[:2])) for p in model.pairs]


def test_held_out_quality(spark):
    out = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.93


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = quality.remainder(F.col("doc_id"), 5) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, ~held) for x in (labels, flipped))
    assert all((p == q).all() for p, q in zip(a.tables, b.tables, strict=True))


# --- sharding


def test_shards_are_even_and_groups_together(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i % 700)) for i in range(2000)] + [(5000 + i, "hot " * 50) for i in range(1000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 10, 256).toPandas()
    by = out.groupby("shard")["size"].sum()
    assert len(by) == 10 and by.max() <= 1.02 * by.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    text = dict(rows)
    out["text"] = out["doc_id"].map(text)
    spread = out[out["text"] != "hot " * 50].groupby("text")["shard"].nunique()
    assert spread.max() == 1
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 16 == s for t, c, s in zip(out["text"], out["text_crc32"], out["size"], strict=True))


def test_map_edits_are_a_new_version(spark, tmp_path):
    old = sharding.SlotMap.initial(64, 4)
    new = old.rebalanced([100 if s % 4 == 0 else 10 for s in range(64)])
    assert new.version == 2 and old.version == 1
    assert all(old.shards[s] == a and new.shards[s] == b for s, a, b in new.edits)
    new.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 4, 2).shards == new.shards


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, f"text {i} " + "x" * (i * 37 % 300)) for i in range(3000)] + [(9000 + i, "hot " * 60) for i in range(700)]
    first = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 8, 512, path).toPandas()
    more = rows + [(20_000 + i, f"later {i} " + "y" * (i * 11 % 200)) for i in range(300)]
    second = sharding.assign(spark.createDataFrame(more, "doc_id bigint, text string"), 8, 512, path).toPandas()
    assert set(first["map_version"]) == {2} and set(second["map_version"]) == {3} and sharding.SlotMap.last_version(spark, path) == 3
    both = first.merge(second, on="doc_id")
    assert (both["virtual_slot_x"] == both["virtual_slot_y"]).all()
    old, new = (sharding.SlotMap.load(spark, path, 8, v) for v in (2, 3))
    assert [s for s, (a, b) in enumerate(zip(old.shards, new.shards, strict=True)) if a != b] == [s for s, _, _ in new.edits]
    assert 0 < len(new.edits) < 60 and len(old.shards) == len(new.shards) == 512 + 8 * sharding.RESERVED
    assert first["split"].sum() == 700 and old.splits == new.splits
    by = second.groupby("shard")["size"].sum()
    assert by.max() <= 1.02 * by.mean()
    for _, part in second.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    with pytest.raises(ValueError):
        sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 9, 512, path)


# --- exact dedup


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
def test_tree_merge_over_many_runs(spark, keep, pick):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 5 + [f"t{rng.randint(0, 60)}"])) for i in range(600)]
    out = exact_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(23), keep, fan_in=3).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    text = dict(rows)
    assert len(out) == 600
    for r in out:
        same = ids[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (pick(same), len(same), r["doc_id"] == pick(same))


def test_one_fixed_row_of_repeated_ones_stays(spark):
    rows = [(1, "same", f"note {k}", {"k": k}) for k in range(30)] + [(0, "same", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, note string, more map<string, int>")
    got = {tuple(exact_dedup.deduplicate(docs.repartition(n), "largest").select("doc_id", "note").first()) for n in (1, 3, 7)}
    assert len(got) == 1 and next(iter(got))[0] == 1


# --- decontamination


def test_longest_matches_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "z z a b c d e f g h i j k l z"), (2, "q w"), (3, "Q, w! a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m"), (8, "q W"), (9, "")], "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.longest_matches(docs, bench).collect())
    assert got == [(1, "7", 2, 0, 12), (2, "8", 0, 0, 2), (3, "8", 0, 0, 2)]
    one = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == one
    assert [r[2] for r in one] == [12, 2, 2]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 8)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == one
    assert sorted(tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()) == got


def test_suffix_arrays_against_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        window, letters = rng.choice([1, 2, 3, 4, 7, 10]), "abCdeF"[: rng.choice([2, 3, 6])]
        made = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))  # noqa: E731, B023
        texts, items = [made(25) for _ in range(rng.randint(0, 5))], [(str(i % 3), made(14)) for i in range(rng.randint(0, 4))]
        array = decontaminate.SuffixArray(texts, window)
        blocks = [decontaminate.TestSuffixes([x for x in items if x[0] == str(k)], window) for k in range(3)]
        spans, found = decontaminate.hits(array, iter(blocks))
        longest = set()
        for i, t in enumerate(texts):
            w, covered, own = t.lower().split(), set(), set()
            for name, x in items:
                y = x.lower().split()
                n = min(window, len(y))
                for p, q in itertools.product(range(len(w) - n + 1), range(len(y) - n + 1 if n else 0)):
                    if w[p : p + n] == y[q : q + n]:
                        covered |= set(range(p, p + n))
                        own.add(name)
                        if not p or not q or w[p - 1] != y[q - 1]:
                            while p + n < len(w) and q + n < len(y) and w[p + n] == y[q + n]:
                                n += 1
                            longest.add((i, name, p, q, n))
                            n = min(window, len(y))
            assert {z for a, b in zip(spans[i][::2], spans[i][1::2], strict=True) for z in range(a, b)} == covered
            assert found[i] == sorted(own)
        assert {m for b in blocks for m in decontaminate.matches(array, b)} == longest


# --- packing


def test_ids_are_the_tokenizers(texts):
    words = packing.WordIds(tokenizer_path())
    assert words.fast
    odd = "It’s ﬁne İstanbul ΑΣ Σ café 'S 'LL x²y ½ ª <|endoftext|> a<|startoftext|>b　日本語 １２３ DON'T\x00b \x1f \xa0x y é 힣"
    for t in [*list(texts.values())[:60], odd, None, " \n"]:
        ids = words.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert words.text(t) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBéßÉ'stlld 0123.,!?-<|>́ 　ªΣ漢", max_size=30))
def test_ids_of_odd_texts(text):
    words = packing.word_ids(tokenizer_path())
    ids = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.text(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_sequences_are_whole_and_few(spark, texts):
    out = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), tokenizer_path()).toPandas()
    words = packing.word_ids(tokenizer_path())
    for doc_id, part in out.sort_values("piece").groupby("doc_id"):
        ids = words.text(texts[doc_id]) + bytes(4)
        assert part["length"].sum() == len(ids) // 4
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
            assert r.length == 2048 or r.piece == len(part) - 1
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
    total = out["length"].sum()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= -(-total // 2048) * 1.01 + 1


def test_every_capacity_holds():
    bins = packing.VectorBestFit((100, 3, 3000))
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    held = defaultdict(list)
    for n in sizes:
        held[bins.add(n)[0]].append(n)
    for part in held.values():
        assert sum(part) <= 100 and len(part) <= 3 and sum(n * n for n in part) <= 3000


# --- near-duplicates


def _aligned(x, y):
    """The longest common subsequence of two sequences of different labels, by the textbook table."""
    best = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            best[j], before = (before + 1 if a == b else max(best[j], best[j - 1])), best[j]
    return best[-1]


def _labels(text):
    """Shingles with their occurrence numbers, in text order."""
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def _links(docs, at_least=0.8):
    """All pairs whose labels align, in order, to at_least."""
    labels = {i: _labels(t) for i, t in docs.items()}
    sets = {i: set(x) for i, x in labels.items()}
    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            n, m = len(labels[i]), len(labels[j])
            common = len(sets[i] & sets[j]) if n and m and min(n, m) >= at_least * max(n, m) else 0
            if common and common / (n + m - common) >= at_least:  # order can only lessen it
                shared = sets[i] & sets[j]
                a, b = ([x for x in labels[k] if x in shared] for k in (i, j))
                common = len(a) if a == b else _aligned(a, b)
                if common / (n + m - common) >= at_least:
                    yield i, j


def _classes(docs, at_least=0.8):
    parent = {i: i for i in docs}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in _links(docs, at_least):
        parent[root(i)] = root(j)
    ids = sorted(docs)
    low = {}
    for i in ids:
        low[root(i)] = min(low.get(root(i), i), i)
    return {i: low[root(i)] for i in ids}


def _family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**9)}"
        yield " ".join(words)


def test_classes_of_corpus(spark, texts):
    got = dict(order_minhash.classes(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == _classes(texts)


def test_large_families_and_shared_passages(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = fresh(40)
    texts = list(_family(rng, fresh(150), 200, 2)) + [t for _ in range(5) for t in _family(rng, fresh(80), 12, 1)]
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(200)] + ["same short text"] * 3 + [" ".join(fresh(50)) for _ in range(50)]
    docs = dict(enumerate(texts))
    got = dict(order_minhash.classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect())
    assert got == _classes(docs)


def _replaced(rng, base, places):
    words = list(base)
    for k in places:
        words[k] = f"w{rng.randint(0, 10**9)}"
    return words


def _found(spark, docs):
    return dict(order_minhash.classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect())


def test_links_through_settled_members(spark):
    """A hub whose variants are like it and not like each other, and chains whose neighbours alone are alike."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    hub = fresh(150)
    texts = [hub] + [_replaced(rng, hub, rng.sample(range(5, 145), 3)) for _ in range(60)]
    for _ in range(3):
        chain = [fresh(150)]
        for k in range(40):
            chain.append(_replaced(rng, chain[-1], [(k * 31 + x) % 140 for x in (0, 50)]))
        texts += chain
    rng.shuffle(texts)
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    assert _found(spark, docs) == _classes(docs)


def test_a_family_is_found_alike_in_any_table(spark):
    """The budget of a round grows with the table and is used up by large groups; links must not depend on either."""
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    hub = fresh(150)
    family = [" ".join(t) for t in [hub, *(_replaced(rng, hub, rng.sample(range(5, 145), 3)) for _ in range(50))]]
    large, skewed = [" ".join(fresh(30)) for _ in range(3000)], list(_family(rng, fresh(150), 200, 2))
    want = list(_classes(dict(enumerate(family))).values())
    for others in (large, skewed):
        got = _found(spark, dict(enumerate(family + others)))
        assert [got[k] for k in range(len(family))] == want


def test_pairs_within_a_common_passage(spark):
    """Near-duplicates whose only common sketches lie in a passage that 200 other documents share, none within two places of another."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = fresh(114)
    texts = [" ".join(fresh(18) + passage + fresh(18)) for _ in range(200)]
    pairs = []
    for _ in range(6000):
        one = fresh(18) + passage + fresh(18)
        pairs.append((" ".join(one), " ".join(_replaced(rng, one, [3, 9, 137]))))
    many = Counter(v for row in order_minhash.Shingles(texts).sketches().tolist() for v in row)
    a, b = (order_minhash.Shingles(list(side)).sketches() for side in zip(*pairs, strict=True))
    for k, pair in enumerate(pairs):
        same = np.flatnonzero(a[k] == b[k])
        gaps = np.diff(np.append(same, same[:1] + order_minhash.SKETCHES))
        if len(same) and (gaps > 2).all() and all(many[int(v)] > 64 for v in a[k][same]):
            texts += pair
    assert len(texts) > 200
    docs = dict(enumerate(texts))
    assert _found(spark, docs) == _classes(docs)


def test_recall_over_groups_of_all_sizes(spark):
    """Links found, of those that brute force finds: families with and without their hub, chains, shared passages of several shares, moved halves."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for size in (2, 5, 30, 300):
        hub = fresh(150)
        texts += [_replaced(rng, hub, rng.sample(range(5, 145), rng.choice([1, 2, 3]))) for _ in range(size)]
    for share in (100, 150, 175):
        passage = fresh(share)
        for _ in range(80):
            own = fresh(200 - share)
            one = own[: len(own) // 2] + passage + own[len(own) // 2 :]
            texts += [one, _replaced(rng, one, [0])]
    for _ in range(10):
        one = fresh(120)
        texts += [one, one[60:] + one[:60]]
    chain = [fresh(100)]
    for k in range(60):
        chain.append(_replaced(rng, chain[-1], [(k * 17) % 95]))
    texts += chain
    rng.shuffle(texts)
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    links, got = list(_links(docs)), _found(spark, docs)
    assert len(links) > 1000
    assert sum(got[i] == got[j] for i, j in links) >= 0.999 * len(links)
    assert got == _classes(docs)


def test_many_texts_around_one_passage_take_no_rounds(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, texts = fresh(170), []
    for _ in range(1000):
        own = fresh(30)
        texts += [own[:15] + passage + own[15:], [*fresh(1), *own[1:15], *passage, *own[15:]]]
    got = _found(spark, {k: " ".join(t) for k, t in enumerate(texts)})
    assert [got[k] for k in range(2000)] == [k - k % 2 for k in range(2000)]


def test_one_row_of_each_class_stays(spark):
    """Also where rows of one identifier have different texts of one class."""
    base = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(base)), (7, " ".join(["z", *base[1:]])), (8, " ".join(base[:-1])), (9, "other words here"), (9, "other words here")]
    kept = order_minhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [7, 9]


def test_alignment_minds_order():
    a = order_minhash.Shingles([" ".join(map(str, range(60)))]).labels
    assert order_minhash.similarity(a, a, 0.8) == 1.0
    assert order_minhash.similarity(a, np.concatenate([a[30:], a[:30]]), 0.8) == 0.0
    assert order_minhash.similarity(a, a[:50], 0.8) == pytest.approx(50 / 56)


# --- substrings


def _without(docs, window):
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out[i] = (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return out


@pytest.mark.parametrize("window", [1, 3, 20])
def test_substrings_on_repetitive_texts(spark, window):
    rng = random.Random(window)
    parts = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(4)]
    docs = {i: " ".join(rng.choice([*parts, "x y", "a a a a a", str(i)]) for _ in range(rng.randint(0, 6))) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    want = _without(docs, window)
    rows = {r["doc_id"]: r for r in substring_dedup.report(df, window).collect()}
    assert {i: (r["n_words"], r["n_removed"]) for i, r in rows.items()} == {i: x[:2] for i, x in want.items()}
    kept = dict(substring_dedup.remove(df, window).collect())
    assert kept == {i: want[i][2] if want[i][1] else t for i, t in docs.items()}


def test_line_runs_over_many_batches(spark):
    rng = random.Random(3)
    docs = {i: "\n".join(rng.choice([f"  Line {rng.randint(0, 30)} ", "", f"own {i} {k}"]) for k in range(rng.randint(0, 8))) for i in range(150)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    held = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")})
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or held[key(x)] < 10) for i, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    for batches, fan_out in ((1, 2), (4, 2), (7, 3)):
        assert dict(line_dedup.deduplicate_lines(df, 10, batches=batches, fan_out=fan_out).collect()) == want


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_identifiers_of_other_types_and_rows_of_one(spark, kind):
    """Text identifiers are compared as text; rows of one identifier don't remove one another."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [("1", passage + " a"), ("1", passage + " b"), ("2", "x " + passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.report(df, 20).collect())
    assert got == [("1", 31, 0), ("1", 31, 0), ("2", 31, 30), ("None", 30, 0)]
    assert line_dedup.line_report(df, 2).count() == exact_dedup.groups(df).count() == order_minhash.classes(df).count() == 4


# --- pipeline


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    kept = pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    scored = {r["doc_id"]: r["score"] for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in scored.items() if x < pipeline.TOXIC_FROM}
    after = pipeline.drop_copies(spark, docs, SF)
    last = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, i), i)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(last.values())
    near = pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(_classes(texts).values()))
    clean = pipeline.drop_contaminated(spark, docs, SF)
    hit = {r["doc_id"] for r in QUERIES["op4_decontaminate"](spark, SF).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - hit
    packed = pipeline.pack(spark, clean, SF).toPandas()
    words = packing.word_ids(tokenizer_path())
    want = {r["doc_id"]: len(words.text(r["text"])) // 4 + 1 for r in clean.collect()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == want
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048 and packed.groupby("sequence_id").size().max() <= packing.MOST_DOCS
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


def test_rehashed_rows_carry_their_class(spark):
    """Classes are joined to nodes before these become many rows."""
    from nearvote.llm import order_minhash

    kinds = "id bigint, size int, labels array<bigint>, cells array<bigint>, c bigint"
    same = [x << 50 for x in range(1, 9)]
    rows = order_minhash._rehashed(spark.createDataFrame([(i, 8, same, [0] * order_minhash.CELLS, 70 + i) for i in range(3)], kinds), 0.8).collect()
    assert {(r["id"], r["c"]) for r in rows} == {(i, 70 + i) for i in range(3)} and len(rows) > 3
