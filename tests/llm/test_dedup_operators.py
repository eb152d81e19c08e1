import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, minhash, repeats, suffix_array, suffix_tree
from tests.llm.cases import rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(units, length):
    counts = collections.Counter(u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        marks = [False] * len(u)
        for i in range(len(u) - length + 1):
            if counts[u[i : i + length]] > 1:
                marks[i : i + length] = [True] * length
        out.append(marks)
    return out


def check_words(spark, data, window, gram):
    units = [tuple(WORD.findall(r[1] or "")) for r in data]
    want = collections.Counter()
    for r, w, marks in zip(data, units, covered(units, window)):
        kept = " ".join(x for x, c in zip(w, marks) if not c)
        want[(r[0], len(w), sum(marks), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = suffix_tree.remove_repeated_words(table(spark, data), window, gram).collect()
    assert collections.Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    return sum(n * k[2] for k, n in want.items())


def check_bytes(spark, data, window, gram):
    units = [(r[1] or "").encode() for r in data]
    want = collections.Counter()
    for r, b, marks in zip(data, units, covered(units, window)):
        runs = sum(c and not (i and marks[i - 1]) for i, c in enumerate(marks))
        kept = bytes(x for x, c in zip(b, marks) if not c)
        want[(r[0], len(b), sum(marks), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))] += 1
    got = suffix_array.remove_repeated_bytes(table(spark, data), window, gram).collect()
    assert collections.Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"]) for r in got) == want


def tangled(n=40):
    """Texts of few words, so that repeats overlap, touch and nest."""
    import random

    rnd = random.Random(9)
    blocks = [" ".join(rnd.choice("abc") for _ in range(25)) for _ in range(6)]
    return [(k, " ".join(rnd.choice(blocks) if rnd.random() < 0.6 else " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 20))) for _ in range(8)), "en", "s", 0, "d", 1, "z") for k in range(n)]


def test_words(spark):
    assert check_words(spark, rows(), 35, 6) > 400
    assert check_words(spark, tangled(), 12, 3) > 0
    assert suffix_tree.remove_repeated_words(table(spark, [])).count() == 0


def test_bytes(spark):
    check_bytes(spark, rows(), 400, 32)
    check_bytes(spark, tangled(), 40, 8)
    assert suffix_array.remove_repeated_bytes(table(spark, [])).count() == 0


def test_hot_keys_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    check_words(spark, tangled(), 12, 3)
    check_bytes(spark, tangled(20), 40, 8)


def test_stretches_change_nothing(monkeypatch):
    unit = repeats.Unit(words=False, length=40, gram=8)
    data = np.frombuffer(" ".join(r[1] for r in tangled(10)).encode(), np.uint8)
    grams, firsts = unit.grams(data, (None, None)), np.array([0, len(data)])
    whole = repeats.anchors(unit, grams, firsts)
    monkeypatch.setattr(repeats, "STRETCH", 97)
    cut = repeats.anchors(unit, grams, firsts)
    spread = lambda g: [(a + k, p) for a, b, p in zip(g["a"], g["b"], g["p"]) for k in range(b - a + 1)]
    assert spread(whole) == spread(cut)


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def mirrored():
    """Pairs of texts that differ in one very long word only, a Thue-Morse word or its complement, where linear hashes agree."""
    same = " ".join(f"s{i}" for i in range(34))
    return [(2 * k + j, f"{same} {thue_morse(1024 << k, ab)}", "en", "s", 0, "d", 1, "z") for k in range(3) for j, ab in enumerate(("ab", "ba"))]


def test_linear_collisions_are_told_apart(spark):
    assert check_words(spark, mirrored(), 35, 6) == 0
    check_bytes(spark, mirrored(), 400, 32)
    lone = [(r[0], r[1].split(" ")[-1], *r[2:]) for r in mirrored()]
    assert collections.Counter(tuple(r) for r in minhash.near_duplicates(table(spark, lone)).collect()) == brute_components(lone)


def test_planted_passages(spark):
    """Passages of 400 bytes and more are found wherever they stand; shorter ones stay."""
    import random

    rnd = random.Random(8)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}" for _ in range(n))
    passages = [own(n) for n in (30, 55, 60, 90, 200)]
    data = [(k, f"{own(rnd.randint(0, 80))} {passages[k % 5]} {own(rnd.randint(0, 80))}", "en", "s", 0, "d", 1, "z") for k in range(400)]
    check_bytes(spark, data, 400, 32)
    assert check_words(spark, data, 35, 6) > 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 700).astype(np.uint8)
    raw = text.tobytes()
    order, rank = suffix_array.refine(text, 40)
    heads = [raw[i : i + 40] for i in order.tolist()]
    assert heads == sorted(heads)
    common = suffix_array.kasai(text, order, rank, 40)
    for a, b in zip(order.tolist(), order[1:].tolist()):
        assert common[b] == min(40, repeats.lcp(raw[a:], raw[b:]))


def test_deep_nodes():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 2, 300).astype(np.uint64)
    starts = np.arange(290)
    heads = collections.Counter(values[i : i + 7].tobytes() for i in starts)
    want = [heads[values[i : i + 7].tobytes()] > 1 for i in starts]
    assert suffix_tree.deep_nodes(values, starts, np.zeros(290, int), 7).tolist() == want


def brute_components(data, size=5, percent=75):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for r in data:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else []))
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i in range(len(data)):
        ids[find(i)].append(data[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return collections.Counter((data[i][0], len(sets[i]), least[find(i)], data[i][0] == least[find(i)]) for i in range(len(data)))


def test_near_duplicates(spark):
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(table(spark)).collect())
    assert got == brute_components(rows())
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def chained(n=40):
    """Each text is linked with its neighbours only, and some texts are just below the limit."""
    words = [f"w{i}" for i in range(400)]
    return [(k, " ".join(words[4 * k : 4 * k + 60]), "en", "s", 0, "d", 1, "z") for k in range(n)]


def test_chains(spark, monkeypatch):
    assert collections.Counter(tuple(r) for r in minhash.near_duplicates(table(spark, chained())).collect()) == brute_components(chained())
    monkeypatch.setattr(minhash, "neighbours", lambda orders: orders.select(F.col("class").alias("x"), F.col("class").alias("y")).limit(0))  # the regions alone
    assert collections.Counter(tuple(r) for r in minhash.near_duplicates(table(spark, chained())).collect()) == brute_components(chained())


def test_neighbours_share_the_base_prefix(spark):
    rng = np.random.default_rng(4)
    keys = {k: bytes([0]) + bytes(rng.integers(0, 2, 4 * minhash.DEPTH, dtype=np.uint8) * (np.arange(4 * minhash.DEPTH) % 4 == 3).astype(np.uint8)) for k in range(200)}
    got = {tuple(r) for r in minhash.neighbours(spark.createDataFrame([(v, k) for k, v in keys.items()], "order binary, class long").coalesce(1)).collect()}
    order = sorted(keys, key=lambda k: (keys[k], k))
    every = {(min(a, b), max(a, b)) for a, b in zip(order, order[1:]) if keys[a][: minhash.PREFIX] == keys[b][: minhash.PREFIX]}
    assert got <= every and len(every) - len(got) < 8  # rows at the edges of ranges


def templated(n=40, linked=24):
    """Texts over one template that are all just below the limit, but for some that have one text just above it."""
    import random

    rnd = random.Random(5)
    template = " ".join(f"t{i}" for i in range(100))
    texts = [template + "".join(f" u{rnd.random()}" for _ in range(24)) for _ in range(n)]
    for k in range(linked):
        w = texts[k].split(" ")
        texts.append(" ".join(w[:-15] + [f"v{rnd.random()}" for _ in range(15)]))
    return [(k, t, "en", "s", 0, "d", 1, "z") for k, t in enumerate(texts)]


def test_crowded_regions_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS", 6)
    want = brute_components(templated())
    assert len({k[2] for k in want}) == 40  # each linked text has one partner
    assert collections.Counter(tuple(r) for r in minhash.near_duplicates(table(spark, templated())).collect()) == want


def test_keep_one(spark):
    data = rows() + [(5, chained()[1][1], "en", "s", 0, "d", 1, "z"), (6, chained()[1][1] + " end", "de", "s", 0, "d", 1, "z")]
    kept = minhash.keep_one(table(spark, data))
    assert kept.columns == table(spark, []).columns
    got = [tuple(r) for r in kept.collect()]
    texts = {r[1] for r in got}
    assert not (chained()[1][1] in texts and chained()[1][1] + " end" in texts)
    want = brute_components(data)
    linked = {(r[2], r[1]) for r in want if r[1]}
    with_words = [r for r in got if WORD.search(r[1] or "")]
    assert len({(r[0], r[1]) for r in with_words}) >= len({c for c, _ in linked})
    again = minhash.near_duplicates(table(spark, [(k, *r[1:]) for k, r in enumerate({r[:2]: r for r in with_words}.values())]))
    assert again.filter("NOT kept").count() == 0  # no two of those that stay are near-duplicates


def test_group_finds_every_component(monkeypatch):
    rng = np.random.default_rng(1)
    for step in (1, 10**6):
        monkeypatch.setattr(minhash, "STEP", step)
        base = rng.integers(0, 2**62, (4, 40), dtype=np.uint64)
        sets = [np.unique(np.concatenate((rng.permutation(base[k % 4])[: rng.integers(30, 40)], rng.integers(0, 2**62, rng.integers(0, 8), dtype=np.uint64)))) for k in range(60)]
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        want, parent = [(i, j) for i in range(60) for j in range(i) if link(sets[i], sets[j])], list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in minhash.Group([(k, k, 0, s.tobytes()) for k, s in enumerate(sets)], 75).links():
            assert (max(x, y), min(x, y)) in want
            parent[find(x)] = find(y)
        assert want and all(find(i) == find(j) for i, j in want)


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS", 4)
    rng = np.random.default_rng(3)
    data = [(g, 1000 * g + k, int(c), int(n)) for g in (1, 2) for k, (c, n) in enumerate(zip(rng.choice([5, 5, 5, 6, 7, 8], 30), rng.choice([60, 75, 80, 100, 134, 400], 30)))]
    tasks = collections.defaultdict(list)
    for r in minhash.blocks(spark.createDataFrame(data, "label long, class long, component long, n long"), 75).collect():
        tasks[r["label"]].append((r["class"], r["component"], r["part"]))
    met = collections.Counter(frozenset((x[0], y[0])) for t in tasks.values() for i, x in enumerate(t) for y in t[:i] if x[1] != y[1] and (x[2] == 0 or x[2] != y[2]))
    want = {frozenset((x[1], y[1])) for i, x in enumerate(data) for y in data[:i] if x[0] == y[0] and x[2] != y[2] and 100 * min(x[3], y[3]) >= 75 * max(x[3], y[3])}
    assert want <= set(met) and set(met.values()) == {1}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    import random

    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
