"""Operators on documents against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import decontam, langid, lmscore, minhash, packing, pii, sharding, toxicity
from patchloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def near_by_force(texts, k, percent):
    """doc_id -> (set size, component) of {doc_id: text}."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(seed, groups=12, copies=10):
    """Texts with copies whose similarity lies on both sides of the threshold."""
    r, out = random.Random(seed), {}
    for g in range(groups):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(3, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            out[len(out) * 7 % 1009] = " ".join(own)
    return out


@pytest.mark.parametrize(("k", "seed"), [(4, 1), (5, 2)])
def test_near_duplicates_by_force(spark, k, seed):
    texts = variants(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=k).collect()}
    assert got == near_by_force(texts, k, 80)


def test_near_duplicates_of_documents(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = minhash.near_duplicates(docs, k=4).collect()
    want = near_by_force(texts, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in near_by_force(texts, 5, 80).items() if i == c}


def test_blocks_find_what_pairs_would(spark):
    """A chain, each text linked with the next only, in one band: the last round alone has to find every link."""
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 8 : i * 8 + 120]) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    feats = minhash.features(df, 4, 32, 5)
    reps = feats.select(F.col("doc_id").alias("rep"), "n", F.transform("bands", lambda b: b * 0 + 1).alias("bands"))
    members = reps.select(F.lit(1).cast("long").alias("key"), "rep", F.col("rep").alias("label"))
    before, minhash.BLOCK = minhash.BLOCK, 7
    try:
        found = {(r.a, r.b) for r in minhash.confirmed_in_blocks(members, reps, df, 4, 80).collect()}
    finally:
        minhash.BLOCK = before
    linked = near_by_force(texts, 4, 80)
    up = {i: i for i in texts}
    for a, b in sorted(found) * 30:
        up[a] = up[b] = min(up[a], up[b])
    assert up == {i: c for i, (_, c) in linked.items()}


def test_super_minhash_estimates_jaccard():
    r = np.random.default_rng(3)
    pool = minhash.mix64(np.arange(3000, dtype=np.uint64))
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            x = r.permutation(pool)[:400]
            both = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:both], r.permutation(np.setdiff1d(pool, x))[: 400 - both]])
            sig = minhash.super_minhash(np.concatenate([x, y]), np.repeat([0, 1], 400), 2, 160)
            errors.append((sig[0] == sig[1]).mean() - both / (800 - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_small_and_large_sets_fill_every_place():
    for n in (1, 2, 7, 160, 5000):
        sig = minhash.super_minhash(minhash.mix64(np.arange(n, dtype=np.uint64)), np.zeros(n, int), 1, 160)
        assert (sig >> np.uint64(32)).max() < 160


def test_shards(spark, docs):
    got = sharding.shard_documents(docs, 40).toPandas()
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(raw) and got.shard.between(0, 39).all() and got.shard.nunique() >= 38
    assert all(s == len(raw[i]) + 16 and c == zlib.crc32(raw[i]) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.groupby("shard")["size"].sum().max() <= got["size"].sum() / 40 + 2 * got["size"].max()


def shards_by_force(points, leaves, together=0.02):
    """points: (dims, crc, id, size) -> the shard of each, by sorting every node whole."""
    out = {}
    wide = lambda own: [max(p[0][d] for p in own) - min(p[0][d] for p in own) for d in range(4)]
    whole = wide(points)

    def cut(own, n, first):
        if n == 1 or not own:
            out.update((p[2], first) for p in own)
            return
        share = [w / max(1, t) for w, t in zip(wide(own), whole)]
        d = share.index(max(share))
        total = sum(p[3] for p in own)
        goal, before = max(1, round(total * (n // 2) / n)), 0
        own = sorted(own, key=lambda p: (p[0][d], p[1], p[2]))
        for p in own:
            if before + p[3] >= goal:
                break
            before += p[3]
        key = lambda q: (q[0][d], q[1])
        group = [q for q in own if key(q) == key(p)]
        weight = sum(q[3] for q in group)
        if len(group) == 1 or weight * n > together * total:
            group, weight = [p], p[3]
        else:
            before = sum(q[3] for q in own if key(q) < key(p))
        low = not before if not before or before + weight == total else before + weight - goal <= goal - before
        ids = {q[2] for q in group}
        left = [q for q in own if q[2] not in ids and (key(q), q[2]) < (key(group[0]), group[0][2])] + (group if low else [])
        kept = {q[2] for q in left}
        cut(left, n // 2, first)
        cut([q for q in own if q[2] not in kept], n - n // 2, first + n // 2)

    cut(points, leaves, 0)
    return out


@pytest.mark.parametrize("leaves", [7, 40])
def test_shards_by_force(spark, docs, leaves):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows += [(5000 + i, f"same text {i % 3}", None if i % 4 else "xx", f"src{i}") for i in range(60)] + [(6000, None, None, None), (6001, "", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    name = lambda x: int.from_bytes((x or "").encode()[:7].ljust(7, b"\0"), "big")
    least = {}
    for _, t, lang, source in rows:
        old = least.get(t or "", (math.inf, math.inf))
        least[t or ""] = min(old[0], name(lang)), min(old[1], name(source))
    points = []
    for i, t, *_ in rows:
        raw, width = (t or "").encode(), 1 << 32
        dims = (min(width - 1, math.floor(math.log2(len(raw) + 16) * (width // 40))), math.floor(len(t) / len(raw) * (width - 1)) if raw else 0, *least[t or ""])
        points.append((dims, zlib.crc32(raw), i, len(raw) + 16))
    assert {r.doc_id: r.shard for r in sharding.shard_documents(df, leaves).collect()} == shards_by_force(points, leaves)


def test_shards_of_even_rows_are_even(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    total = sharding.shard_documents(df, 40).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert total.max() - total.min() <= 0.05 * total.mean()


def test_one_text_in_a_third_of_the_rows(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text here").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    total = sharding.shard_documents(df, 16, slot_rows=50).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(total) == 16 and total.max() - total.min() <= 0.02 * total.mean() + 60


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want = [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
        own = got[got.doc_id == r.doc_id].sort_values("piece")
        assert want == list(zip(own.piece, own.start, own.length, own.ids_crc32))
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    fill = own.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-own.length.sum() // 2048) * 1.02 + 1


@pytest.mark.parametrize("text", ["Foo, bar. BAZ!! l'été It's ÉTÉ", "a\tb c  d\n\n e", "x<|endoftext|>y", "İstanbul ΟΔΟΣ. ß", "été ??!! 12,5 #tag$$$", "日本語テキスト。", ""])
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encode = packing.Encoder(path)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_tree_of_many_partitions(spark):
    r = random.Random(5)
    items = spark.createDataFrame([(i, r.choice((3, 700, 900, 1100, 1500, 2048))) for i in range(900)], "i long, length long").repartition(70)
    got = packing.pack(items, carry=4, fan_in=3).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 900 and (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_leaks(spark):
    r = random.Random(4)
    word = lambda: r.choice("an er th ion es le que sch en ment ti ou".split()) + r.choice("abcdefgh") + r.choice("klmnopq") + r.choice(["", "ing", "ed"])
    run = lambda n: [word() for _ in range(n)]
    items = [run(r.randrange(15, 60)) for _ in range(60)]
    texts, want = {}, set()
    for k in range(300):
        own = run(r.randrange(20, 400))
        if k % 3 == 0:
            item = items[k % 60]
            if k % 2:
                item = [word() if r.random() < 0.12 else w for w in item]
            at = r.randrange(len(own))
            own[at:at] = item
            want.add((k, k % 60))
        texts[k] = " ".join(own).capitalize() + "."
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for block in (2000, 25):
        got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench, block=block).collect()}
        assert len(want - got) <= 0.02 * len(want) and not got - want
    assert {x.doc_id for x in decontam.drop_contaminated(docs, bench).collect()} == set(texts) - {i for i, _ in decontam_ids(docs, bench)}


def decontam_ids(docs, bench):
    return {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench).collect()}


def test_verbatim_leaks_of_long_items(spark):
    r = random.Random(14)
    word = lambda: f"{r.choice('an er th ion es le que sch'.split())}{int(r.paretovariate(0.6)) % 5000}"
    run = lambda n: [word() for _ in range(n)]
    items = [run(n) for n in (200, 300, 450, 700, 1000) for _ in range(8)]
    texts = {}
    for k, item in enumerate(items):
        own = run(r.randrange(50, 1500))
        at = r.randrange(len(own))
        texts[k], texts[1000 + k] = " ".join(own[:at] + item + own[at:]), " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for block in (2000, 15):
        assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench, block=block).collect()} == {(k, k) for k in range(len(items))}


def test_reworded_and_quoted_leaks(spark):
    r = random.Random(15)
    word = lambda: f"{r.choice('an er th ion es le que sch'.split())}{int(r.paretovariate(0.6)) % 5000}"
    run = lambda n: [word() for _ in range(n)]
    items = [run(r.randrange(16, 60)) for _ in range(50)] + [run(300) for _ in range(10)]

    def quote(item, share):
        n = max(8, math.ceil(len(item) * share))
        at = r.randrange(len(item) - n + 1)
        return item[at : at + n]

    kinds = {(0.2, 0): 0.93, (0.3, 0): 0.85, (0.4, 0): 0.65, (0, 0.5): 0.95, (0, 0.7): 0.97}
    texts = {}
    for kind, (swap, share) in enumerate(kinds):
        for k, item in enumerate(items):
            own = run(r.randrange(50, 400))
            at = r.randrange(len(own))
            own[at:at] = quote(item, share) if share else [word() if r.random() < swap else w for w in item]
            texts[kind * 100 + k] = " ".join(own)
    texts |= {1000 + k: " ".join(run(r.randrange(50, 400))) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench).collect()}
    for kind, (what, least) in enumerate(kinds.items()):
        assert sum((kind * 100 + k, k) in got for k in range(len(items))) >= least * len(items), what
    assert all(d < 1000 and i == d % 100 for d, i in got)


def test_very_long_texts(spark, monkeypatch):
    """A text of many cuts: items are found wherever they stand, also on a cut, and a cut anywhere changes nothing."""
    r = random.Random(16)
    run = lambda n: [f"{r.choice('an er th ion es'.split())}{int(r.paretovariate(0.6)) % 5000}" for _ in range(n)]
    items = [run(r.randrange(16, 60)) for _ in range(12)] + [run(8)]
    own = run(150_000)
    for k, item in enumerate(items[:-1]):
        at = 48_000 - 16 - 20 if not k else 12_000 * k
        own[at:at] = item
    text = " ".join(own)
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert decontam_ids(docs, bench) == {(1, k) for k in range(12)}
    v = decontam.Vocabulary(" ".join(x) for x in items)
    whole = v.ids(text)
    for long in (1, 7, 1000):
        monkeypatch.setattr(decontam, "LONG", long)
        assert (v.ids(text) == whole).all() and "".join(decontam.parts(text[:5000])) == text[:5000]
    short = v.ids(" ".join(["zz"] * 1000 + items[1] + ["zz"] * 2500 + items[2] + ["zz"] * 700))
    basis = np.random.default_rng(1).standard_normal((len(v) + 1, 64)).astype(np.float32)
    idf = np.ones(len(v) + 1, np.float32)
    idf[0] = 0
    index = decontam.Index([(i, " ".join(x)) for i, x in enumerate(items)], v, idf, basis, 0.55, 0.8, 0.5, 0.4)
    hits = lambda most: {h[:2] for whole, batch in decontam._batches(iter([short]), most) for h in index.hits(batch, whole)}
    assert hits(48_000) >= {(0, 1), (0, 2)}
    for most in (32, 48, 160, 1600):
        assert hits(most) == hits(48_000)


def test_common_subsequence_by_force():
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(1, 70)))) for i in range(20)]
    v = decontam.Vocabulary(t for _, t in items)
    index = decontam.Index(items, v, np.ones(len(v) + 1, np.float32), np.ones((len(v) + 1, 2), np.float32), 0.5, 0.8, 0.5, 0.75)
    for k in range(20):
        text = [v.get(r.choice("abcdefg").encode(), 0) for _ in range(50)]
        a = index.words[k]
        table = [[0] * (len(text) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(text):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert index.common(k, text) == table[-1][-1] / len(a)


@pytest.mark.parametrize("head", [400_000, 300])
def test_base_scores_by_force(spark, docs, head):
    got = {r.doc_id: r for r in lmscore.score_documents(docs, head=head, seeds=8).collect()}
    rows = docs.collect()
    c, n = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            c.update(r.text.encode().lower().split())
            n += 1
    total, types = sum(c.values()) + n, len(c) + 1
    for r in rows:
        w = r.text.encode().lower().split()
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (types + 1))) for x in [*(c[y] for y in w), n])
        own = got[r.doc_id]
        assert abs(own.base_score - base) < 1e-6 and own.train_tokens == total
        assert (own.n_tokens, own.n_known) == (len(w) + 1, sum(y in c for y in w) + 1)
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_the_head(spark, docs):
    a, b = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in lmscore.score_documents(docs, head=head, seeds=8).collect()} for head in (400_000, 300))
    assert a.keys() == b.keys()
    for i, own in a.items():
        assert own == pytest.approx(b[i], abs=1e-6)


@pytest.mark.parametrize("head", [400_000, 40])
def test_scores_by_force(spark, head):
    """Every class and every score against a plain reading of the model, where only the exchange of seeds is shared."""
    import xxhash

    r = random.Random(31)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = {i: " ".join(vocabulary[min(299, int(r.paretovariate(0.8)) - 1)] + r.choice(["", "", "x"]) for _ in range(r.randrange(0, 60))) for i in range(300)}
    texts[500] = None
    got = {x.doc_id: x.score for x in lmscore.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), head=head).collect()}
    words = {i: (t or "").split() for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    n = Counter(w for i in train for w in words[i])
    once = sum(v == 1 for v in n.values())
    classes = round((len(n) - once) ** 0.3)
    h = lambda w: xxhash.xxh3_64_intdigest(w.encode()) - (1 << 63)
    seeds = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], h(w)))[: 12 * classes]
    pairs = lambda symbol: Counter(p for i in train for s in [["end", *words[i], "end"]] for p in zip(map(symbol, s), map(symbol, s[1:])))
    size = len(seeds)
    number = {w: i for i, w in enumerate(seeds)} | {"end": size + 1}
    table = np.zeros((size + 2, size + 2))
    for (a, b), c in pairs(lambda w: number.get(w, size)).items():
        table[a, b] = c
    of = lmscore.exchange(table, size, classes)
    own = {w: int(of[i]) for w, i in number.items()}
    beside = pairs(lambda w: own.get(w, classes))
    near = lambda a, b: beside[a, b] + 0.1
    around = {w: [Counter(), Counter()] for w in n}
    for i in train:
        full = ["end", *words[i], "end"]
        for a, w, b in zip(full, full[1:], full[2:]):
            around[w][0][own.get(a, classes)] += 1
            around[w][1][own.get(b, classes)] += 1
    symbols = {**own}
    k = range(classes + 2)
    for w in n:
        if n[w] > 1 and w not in own:
            worth = [sum(c * math.log(near(a, q) / sum(near(x, q) for x in k)) for a, c in around[w][0].items()) + sum(c * math.log(near(q, b) / sum(near(q, x) for x in k)) for b, c in around[w][1].items()) for q in range(classes)]
            symbols[w] = max(range(classes), key=lambda q: (round(worth[q], 7), -q))
    symbol = lambda w: symbols.get(w, classes)
    flow = pairs(symbol)
    total = sum(flow.values())
    into, out = Counter(), Counter()
    for (a, b), c in flow.items():
        into[b] += c
        out[a] += c
    share = lambda b: (into[b] + 0.5) / (total + 0.5 * len(k))
    unknown = min(0.9, (once + 0.5) / (once + 1))
    for i, w in words.items():
        full, score = ["end", *w, "end"], 0.0
        for a, b in zip(full, full[1:]):
            x, y = symbol(a), symbol(b)
            score += math.log10((flow[x, y] + 5 * share(y)) / (out[x] + 5))
            if b != "end":
                score += math.log10(n[b] / into[y] if n[b] > 1 else (1 - unknown) / once if n[b] else unknown)
        assert got[i] == pytest.approx(score, abs=1e-6)


def test_exchange_raises_likelihood():
    r = np.random.default_rng(1)
    truth = r.integers(0, 4, 60)
    flow = r.dirichlet(np.full(4, 0.2), 4)
    s = [0]
    for _ in range(40_000):
        c = r.choice(4, p=flow[truth[s[-1]]])
        s.append(int(r.choice(np.flatnonzero(truth == c))))
    table = np.zeros((62, 62))
    np.add.at(table, (s[:-1], s[1:]), 1)
    table[np.arange(60), np.arange(60)] += r.integers(0, 300, 60)  # words that repeat
    of = lmscore.exchange(table, 60, 4)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

    def likelihood(of):
        m = np.zeros((62, of.max() + 1))
        m[np.arange(62), of] = 1
        t = m.T @ table @ m
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    for w in range(60):  # no single move is better, by the likelihood itself
        for c in range(4):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(of) + 2e-3
    start = np.concatenate([np.arange(60) % 4, [4, 5]])
    assert likelihood(of) > likelihood(start)
    assert likelihood(of) >= likelihood(np.concatenate([truth, [4, 5]])) - abs(likelihood(start)) * 0.02


def test_languages(spark, docs):
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    profiles = langid.fit(docs)
    assert profiles.predict(None) == profiles.predict("12 ?! 3") == ("und", 0.0)


def test_rank_distance_by_force():
    def grams(t):
        n = Counter()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f"_{w}_"
            n.update(w[1:-1])
            for k in (2, 3):
                n.update(w[i : i + k] for i in range(len(w) - k + 1) if k > 1)
        return n

    text = "The cat, the hat! éa 12 a-b"
    code = lambda g: len(g) << 60 | sum((0 if c == "_" else ord(c)) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = Counter(langid.grams(text).tolist())
    want = Counter({code(g): n for g, n in grams(text).items() if len(g) == 1 or g[:2] != "__"})
    # a one-letter word has the trigram with a boundary at both ends, and bigrams with one
    assert own == want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_force(text):
    out = []
    for n, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub(r"[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in s.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_base_spans_by_force(spark, docs):
    r = random.Random(9)
    odd = ["".join(r.choice("ab1290.@-+ ()%_é") for _ in range(120)) for _ in range(400)] + ["a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8", "+1 234-567-8901 4111 1111 1111 1111", "x@y..z a.b@c-d.e-"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + x.doc_id, x.text) for x in docs.collect()]
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_by_force(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_candidates_that_trees_select():
    find = lambda t: [pii.KINDS[k] for _, k, _ in pii.model().spans(t, pii.base_spans(t))]
    assert find('my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here') == ["secret"]
    assert find("phone (212) 555-0187 today") == ["phone"]
    assert find("on 2024-01-15 we met, chapter 12 of 300") == []
    assert pii.masked("mail bob@example.com or +1 (217) 555-1234 now") == "mail [EMAIL] or [PHONE] now"


@pytest.mark.parametrize("text", ["anna.er at mail.org", "anna.er at mail (dot) org", "anna.er at mail [dot] org", "anna.er(at)mail.org"])
def test_disguised_addresses_without_other_signs(text):
    for own in (text, f"write to {text} now", f"see you. {text}, or x (at) y. A dot in it"):
        assert any(own[s:e] == text for s, k, e in pii.candidates(own) if k == 0)
        assert text not in pii.masked(own) and "[EMAIL]" in pii.masked(own)
    prose = "we arrived at noon. Then we left, and looked at this. It was late"
    assert pii.masked(prose) == prose


def test_numbers_side_by_side():
    find = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.model().spans(t, pii.base_spans(t))]
    assert find("555-123-4567 555-987-6543 555-222-3333") == [("phone", "555-123-4567"), ("phone", "555-987-6543"), ("phone", "555-222-3333")]
    assert find("call 555-123-4567 4111 1111 1111 1111 now") == [("phone", "555-123-4567"), ("card", "4111 1111 1111 1111")]
    assert find("phone (212) 555-0187 (212) 555-0188 today") == [("phone", "(212) 555-0187"), ("phone", "(212) 555-0188")]
    for t in ("2024-01-15 2024-02-16 2023-11-30", "1 22 333 4 55 666 7 88 999 1 22", "3.14 2.71 1.41 100 200 300 400"):
        assert find(t) == []
    assert len(pii.candidates("1 " * 20_000)) < 20_000 * 19


def test_long_texts_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 100_000, "@" * 100_000, "a.b@" * 30_000, "1." * 100_000):
        pii.base_spans(t)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grammar = toxicity.fit(docs, labels)
    got = toxicity.score(docs, grammar).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    hit, gold = held.predicted == 1, held.toxic == 1
    assert (hit & gold).sum() / gold.sum() > 0.85 and (hit & gold).sum() / hit.sum() > 0.9
    kept = toxicity.drop_toxic(docs, grammar)
    assert kept.columns == docs.columns and kept.count() == docs.count() - toxicity.score(docs, grammar).where("predicted = 1").count()


def test_grammar_weighs_clauses():
    states = (toxicity.EXPECTED * 2).tolist()
    g = toxicity.Grammar({"idiot": 0}, {"worth": 1}, {"hurt": {"you": 2}}, [2.0, 1.0, 2.0], states, -3.0)
    plain, targeted, negated, told = (g.score(t) for t in ("an idiot came", "you are an idiot", "there is not an idiot", "as someone said, the idiot came"))
    assert targeted > plain > negated and plain > told
    assert list(g.clauses("nothing. worthless!")) == [({1}, {0})] and list(g.clauses("not. idiot")) == [({0}, {0})]
    assert g.score(None) == g.score("") == g.score("quiet words") < g.score("idiot")
    assert g.score("I will hurt all of you") > g.score("hurt. you") == g.score("you hurt") == g.score("") == g.score("hurt a b c you")
    assert g.score("idiot. " * 50) == g.score("idiot") < g.score("worthless idiot")  # clauses don't add up, terminals of one do


def test_clauses_by_force():
    """The composition against a plain reading of its description, word by word over whole clauses."""
    r = random.Random(21)
    words = "idiot worthless hurt you them not never said quiet calm and und".split()
    g = toxicity.Grammar({"idiot": 0}, {"worth": 1}, {"hurt": {"you": 2, "calm": 3}, "and": {"und": 4}}, [0.0] * 5)
    terminal = lambda w: [0] if w == "idiot" else [1] if w.startswith("worth") else []
    for _ in range(400):
        clauses = [[r.choice(words) for _ in range(r.randrange(14))] for _ in range(4)]
        want = []
        for own in clauses:
            met = [(i, k, 0) for i, w in enumerate(own) for k in terminal(w)]
            met += [(j, g.pairs[a][own[j]], 8) for i, a in enumerate(own) for j in range(i + 1, min(len(own), i + 4)) if own[j] in g.pairs.get(a, {})]
            state = lambda i, own=own: 4 * any(w in toxicity.TARGETS for w in own[max(0, i - 6) : i + 7]) + 2 * any(w in toxicity.NEGATIONS for w in own[max(0, i - 3) : i + 1]) + any(w in toxicity.REPORTS for w in own[: i + 1])
            if met:
                want.append(({k for _, k, _ in met}, {kind + state(i) for i, _, kind in met}))
        assert list(g.clauses(". ".join(map(" ".join, clauses)))) == want


def test_threats_of_ordinary_words(spark):
    """Two words that are common in clean texts are a threat in their order and side by side."""
    r = random.Random(22)
    filler = lambda n: [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in r.choices(range(200), k=n)]
    rows = []
    for i in range(1200):
        own = filler(40) + ["."] + filler(10)
        toxic = i % 6 == 0
        if toxic:
            own[20:20] = ["burn", *filler(r.randrange(2)), "house"]
        else:
            own[5:5], own[30:30] = ["burn"], ["house"]
        rows.append((i, " ".join(own), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs, docs)
    assert "house" in grammar.pairs.get("burn", {})
    got = {x.doc_id: x.predicted for x in toxicity.score(docs, grammar).collect()}
    assert sum(got[i] == t for i, _, t in rows) > 0.97 * len(rows)
    assert grammar.score("they burn the house") > 0.3 > max(grammar.score("the house. they burn"), grammar.score("house burn"))


def test_copies_teach_no_words(spark):
    rows = [(i, "zork the same text of many copies. " + f"fine words {i}", 1) for i in range(60)]
    rows += [(100 + i, f"a{chr(97 + i % 26)} clown b{chr(97 + i // 26)} came", 1) for i in range(60)] + [(200 + i, f"c{chr(97 + i % 26)} clean d{chr(97 + i // 26)} text", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs, docs)
    assert "clown" in grammar.words and "zork" not in grammar.words


def test_token_ids_by_force():
    """Random texts of letters, marks, spaces and signs that normalisation joins, against the tokenizer on whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    pools = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3 + "  \n\t.,!?;:|*#$%&'\"-0123456789", "éèêëàâäÄÖÜßñÑçœŒæøÅİıŉſẞªºµĿŀĲ\u2126\u212a\u212b", "\u00a0\u2009\u3000\u0085\x1c\u200b", "\u0301\u0327\u0308\u0307", "ΑΣσςБг漢かな한\u1112\u1161", "²½٣５", "👍\U0001f3fd\ufeff"]
    extra = ["<|endoftext|>", "'S", "İ,", "ß.", "'re"]
    for name, n in (("word_bpe_49k.json", 50_000), ("byte_bpe_50k.json", 2_000)):
        own, plain, r = packing.Encoder(public_tokenizers.path(name), limit=500), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(3)
        texts = ["".join(r.choice(r.choice(pools)) if r.random() < 0.9 else r.choice(extra) for _ in range(r.randrange(1, 14))) for _ in range(n)]
        for text in texts:
            assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", ["ann@mail.org ", "555-123-4567 ", "10.1.2.3 4111 1111 1111 1111 ", "key = abcdef0123456789abcdef0123456789 ", "anna at mail dot org ", "5", "1 2 ", "a@", "+1 "])
def test_spans_of_many_matches(unit):
    """Time is near linear in matches, spans don't overlap, and all base spans stay."""
    import time

    pii.model()
    took = []
    for n in (10_000, 80_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        base = pii.base_spans(text)
        spans = pii.model().spans(text, base)
        took.append(time.process_time() - began)
        own = set(base)
        assert own <= set(spans)
        added = [s for s in spans if s not in own]
        assert all(a[2] <= b[0] for a, b in zip(added, added[1:]))
    assert took[1] < 24 * took[0] + 0.5


def test_stashes_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from patchloom.llm import common

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, _patchloom_shipped=True))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_root(fake(master))


def test_language_distances_by_force(spark, docs):
    """Profiles, distances, ties and scores against plain counting of n-grams as tuples."""
    length = 60

    def grams(text):
        flat = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        out = Counter()
        for w in flat:
            x = [0, *(max(1, ord(c) & 0xFFFF) for c in w), 0]
            for n in (1, 2, 3):
                for i in range(len(x) - n + 1):
                    g = x[i : i + n]
                    if any(g) and (n > 1 or g[0]) and all(g[1:-1]):
                        out[n, *g] += 1
        return out

    ranked = lambda n: sorted(n, key=lambda g: (-n[g], g))[:length]
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()] + [(9000, None, "und"), (9001, "en", None), (9002, "en", ""), (9003, "de", "12 !"), (9004, "fr", "a")]
    total = {}
    for i, lang, text in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 5:
            total.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(n))} for lang, n in sorted(total.items()) if n}
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df, length=length)).collect()}
    for i, _, text in rows:
        own = ranked(grams(text))
        far = sorted((sum(abs(p[g] - k) if g in p else length for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        want = (far[0][1], 0.5 + 0.5 * (far[1][0] - far[0][0]) / max(1, far[1][0])) if own else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), i


def test_links_of_components(spark):
    from patchloom.llm.common import Stash
    from patchloom.llm.graph import components

    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(700)]
    got = {x.id: x.component_id for x in components(spark.createDataFrame(links, "a long, b long").repartition(6), Stash(spark, "t")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == {k: v for k, v in want.items() if k != v}
