import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestone.llm import bpe, chat, exact_dedup, packing, quality, token_count, toxicity
from lodestone.llm.registry import BYTE_BPE, PIECE_MODEL, tokenizer
from tests.llm.cases import SCHEMA, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokenizer(BYTE_BPE)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


ENCODER = bpe.Encoder(bpe.vocabulary(PATH), cached=50)
DECODER = bpe.Decoder(bpe.vocabulary(PATH))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n'aestll1²é中😀_!\x1c\x85<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_bpe_is_exact(reference, texts):
    want = reference.encode_batch(texts, add_special_tokens=False)
    got = ENCODER.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert [DECODER.decode(g) for g in got] == [reference.decode(w.ids, skip_special_tokens=False) for w in want]


def test_bpe_query_cases(spark, reference):
    got = {(r["doc_id"], r["ids_sha256"], r["n_tokens"]) for r in bpe.round_trip(table(spark), PATH).collect()}
    want = set()
    for r in rows():
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        want.add((r[0], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
    assert got == want and bpe.round_trip(table(spark, []), PATH).count() == 0


def test_colliding_and_many_words(reference):
    """Thue-Morse words and their complements, where linear hashes agree, and words whose sort hash is made to agree."""
    pairs = [["".join(ab[bin(i).count("1") % 2] for i in range(n)) for ab in ("ab", "ba")] for n in (512, 1024, 2048, 4096)]
    texts = [t for p in pairs for t in p] + [" ".join(p) for p in pairs]
    assert [np.frombuffer(g, "<u4").tolist() for g in ENCODER.encode(texts)] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_words_of_one_hash_are_told_apart(reference, monkeypatch):
    monkeypatch.setattr(bpe, "mix", lambda h: h & np.uint64(3))
    encoder = bpe.Encoder(bpe.vocabulary(PATH), cached=40)
    for k in range(4):
        texts = [" ".join(f"word{i * k} é{i}" for i in range(30 * k)), "a\0", "a", "\0\0 \0"]
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_long_words_and_runs(reference):
    texts = ["a" * 500, "ab" * 300, " " * 100, "é" * 200, "\n" * 77 + "x", "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    assert [np.frombuffer(g, "<u4").tolist() for g in ENCODER.encode(texts)] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeéñ  ▁中😀\n\t<>0x"), max_size=30))
def test_counts_are_exact(text):
    assert COUNTER.text(text) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)


VOCAB, UNK, FALLBACK = token_count.pieces_of(tokenizer(PIECE_MODEL))
COUNTER = token_count.Counter(VOCAB, FALLBACK, cached=100)
UNIGRAM = Tokenizer(models.Unigram(VOCAB, UNK, FALLBACK))
UNIGRAM.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)


def test_count_query(spark):
    got = sorted(map(str, token_count.token_counts(table(spark), tokenizer(PIECE_MODEL)).collect()))
    assert got == sorted(f"Row(doc_id={r[0]}, n_tokens={len(UNIGRAM.encode(r[1] or '', add_special_tokens=False).ids)})" for r in rows())


def test_exact_dedup_cases(spark):
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_dedup(table(spark)).collect())
    groups = collections.defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = collections.Counter((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert got == want and exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_digest_index_persists(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, "digests_first", 4, f"file://{tmp_path}/index")
    assert exact_dedup.drop_copies(docs, index).count() == 2
    spark.sql("DROP TABLE digests_first")
    again = exact_dedup.DigestIndex(spark, "digests_again", 4, f"file://{tmp_path}/index").open()
    later = spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.drop_copies(later, again).collect()] == [8]
    assert again.table().count() == 3
    assert {tuple(r)[:4] for r in exact_dedup.exact_dedup(later, again).collect()} == {(9, 2, 1, False), (8, 8, 1, True)}
    plan = later.select(exact_dedup.digest(F.col("text")).alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index is read in its buckets
    spark.sql("DROP TABLE digests_again")


def test_drop_copies_leaves_one_row(spark):
    got = exact_dedup.drop_copies(table(spark)).collect()
    keep = {}
    for r in rows():
        keep[r[1] or ""] = max(keep.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert collections.Counter((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == collections.Counter(keep.items())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestone_digests")]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_rules(table(spark), labels).collect())
    want = collections.Counter()
    for r in rows():
        b = brute_quality(r[1])
        want[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want and quality.quality_rules(table(spark, []), labels.limit(0)).count() == 0


def test_binomial_bound(spark):
    from math import comb, log

    df = spark.createDataFrame([(0, 10), (3, 10), (5, 400)], "k long, n long")
    got = [r[0] for r in df.select(quality.log_binomial_cdf(F.col("k"), F.col("n"), 0.03)).collect()]
    want = [log(sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))) for k, n in ((0, 10), (3, 10), (5, 400))]
    assert got == pytest.approx(want, rel=1e-9)


def test_thresholds_limit_false_rejection(spark):
    clean, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i}### &&&" for i in range(60))
    data = [(i, clean + f" tail{i}", "en", "s", 0, "d", 1, "z") for i in range(1500)] + [(2000 + i, junk + f" t{i}", "en", "s", 0, "d", 1, "z") for i in range(300)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000)) for r in data], "doc_id long, quality int")
    got = quality.quality_rules(table(spark, data), labels)
    assert got.filter("doc_id < 2000 AND NOT kept").count() == 0 and got.filter("doc_id >= 2000 AND kept").count() == 0
    kept = quality.keep_good(table(spark, data), labels)
    assert kept.count() == 1500 and kept.columns == table(spark, []).columns
    assert quality.quality_rules(table(spark, data), labels.limit(40)).filter("NOT kept").count() == 0  # too few labels prove nothing


def test_every_proven_stratum_rejects(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_STRATA", 1)
    clean, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i}### &&&" for i in range(60))
    data = [(i, (clean if i < 4000 else junk) + f" tail{i}", ("en", "de")[i % 2], "s", 0, "d", 1, "z") for i in range(4600)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 4000)) for r in data], "doc_id long, quality int")
    got = quality.quality_rules(table(spark, data), labels)
    assert got.count() == 4600 and got.filter("(doc_id < 4000) != kept").count() == 0
    assert quality.keep_good(table(spark, data), labels).count() == 4000


def test_toxicity_on_held_out_rows(spark):
    import random

    rnd = random.Random(4)
    bad = ["idiot", "scum", "trash", "moron"]
    make = lambda toxic: " ".join(rnd.choice(bad) if toxic and rnd.random() < 0.1 else f"w{rnd.randint(0, 300)}" for _ in range(80))
    truth = {i: int(i % 4 == 0) for i in range(600)}
    data = [(i, make(t), "en", "s", 0, "d", 1, "z") for i, t in truth.items()] + rows()
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(table(spark, data), labels).collect()]
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] > 100]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(table(spark), labels.limit(0)).collect()} == {0}


def test_intercept_is_for_the_shares_of_all_labels(spark, monkeypatch):
    data = [(i, f"w{i % 7} w{i % 11} " + ("idiot " * 3 if i % 4 == 0 else f"x{i}"), "en", "s", 0, "d", 1, "z") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: [0.0] * 4)
    used = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = sum(i % 4 == 0 for i in used)
    assert toxic < 150 < len(used) - toxic
    assert toxicity.learn(table(spark, data), labels).weights[0] == 0  # no cap reached
    assert abs(toxicity.learn(table(spark, data), labels, most_labelled=150).weights[0] - np.log(150 / (len(used) - toxic))) < 1e-9
    assert abs(toxicity.learn(table(spark, data), labels, most_labelled=60).weights[0] - np.log(toxic / (len(used) - toxic))) < 1e-9


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = rng.normal(-0.2, 2, 14)  # no ties

        def inside(a, b):
            if a >= b:
                return []
            best = max(((s[i:j].sum(), -i, -(j - i)) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i = -best[1]
            j = i - best[2]
            return inside(a, i) + [s[i:j].sum()] + inside(j, b)

        got = toxicity.maximal_segments(s)
        assert sum(x for *_, x in got) == pytest.approx(sum(inside(0, len(s))))
        assert max((x for *_, x in got), default=0) == pytest.approx(max((s[i:j].sum() for i in range(14) for j in range(i + 1, 15) if s[i:j].sum() > 0), default=0))


def test_packing(spark, reference):
    long = " ".join(str(i) for i in range(3000))
    data = rows() + [(900, long, "en", "s", 0, "d", 1, "z")]
    got = packing.best_fit_pack(table(spark, data), PATH, 64).collect()
    want = collections.Counter()
    for r in data:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(min(first, len(ids)), len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * sum(r["length"] for r in got) / 64 + 1
    assert packing.best_fit_pack(table(spark, []), PATH).count() == 0


def best_fit(sizes, capacity):
    """Number of sequences of best fit on falling sizes, one by one."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("low, high", [(1, 12), (20, 100), (30, 64)])
def test_packing_against_best_fit(spark, monkeypatch, low, high):
    import random

    rnd = random.Random(low)
    sizes = [rnd.randint(low, high) for _ in range(1500)] + [high] * 500
    data = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "cut_pieces", lambda docs, *_: docs)
    got = packing.best_fit_pack(data, PATH, 100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(sizes))
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        ends = [o + n for o, n in sorted(places)]
        assert ends[-1] <= 100 and [o for o, _ in sorted(places)] == [0, *ends[:-1]]
    assert len(fill) <= 1.02 * best_fit(sizes, 100) + 1


def test_sweep_gives_each_bundle_a_gap():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        left = {rnd.randint(1, 50): rnd.randint(1, 400) for _ in range(12)}
        room = {rnd.randint(1, 50): rnd.randint(1, 40) for _ in range(12)}
        gaps = [g for g in sorted(room) for _ in range(room[g])]
        used = set()
        runs = packing.sweep(left, room, 12)
        before = {g: sum(n for x, n in room.items() if x < g) for g in room}
        met = packing.met_sizes(runs, before, room)
        assert len(met) <= len(runs) + len(room)
        assert [(p, gap, took) for gap, low, high, took in met for p in range(low, high)] == [(p, gaps[p], b * s) for s, b, n, at in runs for p in range(at, at + n)]
        for size, bundle, n, place in runs:
            assert bundle * n <= left[size] and not used & set(range(place, place + n))
            used |= set(range(place, place + n))
            assert all(gaps[p] >= bundle * size for p in range(place, place + n))
        singles = sum(n for _, b, n, _ in packing.sweep(left, room, 1))
        most, free = 0, list(gaps)  # the greatest number of pieces that can have a gap each
        for s in sorted(s for s, n in left.items() for _ in range(n)):
            if fit := [g for g in free if g >= s]:
                free.remove(min(fit))
                most += 1
        assert singles == most


def test_chat_cases(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "a"), (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "b"), (3, "chosen", 0, None, None), (3, "rejected", 0, None, None), (None, "chosen", None, "user", "x"),
    ]
    got = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and learnt(got[1], "chosen") == ["good<|im_end|>\n"] and learnt(got[1], "rejected") == ["bad<|im_end|>\n"]
    assert (got[2]["prompt"], got[2]["chosen"]) == ("", "<|im_start|>user\na<|im_end|>\n") and got[2]["chosen_loss"] == ""
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["prompt"] == "<|im_start|>\n<|im_end|>\n"
    assert got[None]["chosen"].startswith("<|im_start|>user\nx") and got[None]["rejected"] == ""


def learnt(record, side):
    cuts = [tuple(map(int, c.split("-"))) for c in record[f"{side}_loss"].split(",") if c]
    return [record[side][a:b] for a, b in cuts]


def test_long_records_go_on(spark):
    turns = [(1, side, k, ("user", "assistant")[k % 2], f"{k}" if k < 30 else f"{side}{k}") for side in ("chosen", "rejected") for k in range(60)]
    turns += [(2, "chosen", 0, "user", f"v{k}") for k in range(40)]
    rows = chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string"), chunk=8).collect()
    one = sorted((r for r in rows if r["pair_id"] == 1), key=lambda r: r["chunk"])
    assert [r["chunk"] for r in one] == [0, 1, 2, 3]
    for part, wanted in (("prompt", range(30)), ("chosen", range(30, 60)), ("rejected", range(30, 60))):
        text = "".join(r[part] for r in one)
        assert re.findall(r"\n([a-z]*)(\d+)<", text) == [("" if part == "prompt" else part, str(k)) for k in wanted]
    assert [x for r in one for x in learnt(r, "rejected")] == [f"rejected{k}<|im_end|>\n" for k in range(31, 60, 2)]
    two = [r for r in rows if r["pair_id"] == 2]
    assert len(two) > 1 and sorted(x for r in two for x in re.findall(r"v\d+", r["chosen"])) == sorted(f"v{k}" for k in range(40))


def test_other_answers(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a2"), (2, 2, "user", "thanks"), (3, 0, "user", "q3"), (3, 1, "assistant", "a3"), (4, 0, "user", "alone"), (5, 0, "user", "u"), (5, 0, "assistant", "x"), (None, 0, "user", "n"), (None, None, "assistant", "m")]
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.with_other_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (learnt(got[2], "chosen"), learnt(got[2], "rejected")) == (["a2<|im_end|>\n"], ["a3<|im_end|>\n"]) and "thanks" not in got[2]["prompt"] + got[2]["chosen"]
    assert got[4]["prompt"] and not got[4]["chosen"] and "x<" in got[5]["chosen"] and "x<" not in got[5]["rejected"]
    assert learnt(got[None], "chosen") == ["m<|im_end|>\n"] and got[None]["rejected"] == ""


def test_schema_is_used():
    assert SCHEMA.count(",") == 7
