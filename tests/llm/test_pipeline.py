"""The pipeline against its stages done by hand on a small corpus."""

import collections
import hashlib
import re

import corpus_pipeline
from tests.llm.cases import rows, table
from tests.llm.test_dedup_operators import brute_components, covered
from tests.llm.test_text_operators import brute_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    """Repeated ids, null ids and repeated rows among copies and near copies; id 900 has a near copy of another id's text and a text of its own."""
    out = rows(3, 80)
    near = next(r[1] for r in out if r[1] and len(r[1].split()) > 100 and len(set(r[1].split())) > 90)
    own = " ".join(f"own{k}" for k in range(80))
    return [*out, *out[:5], (900, near + " end", "en", "s", 0, "d", 1, "z"), (900, own, "en", "s", 0, "d", 1, "z"), (901, own + " end", "en", "s", 0, "d", 1, "z"), (901, own + " end", "en", "s", 0, "d", 1, "z")]


def pairs(got):
    return collections.Counter((r["doc_id"], r["text"]) for r in got)


def test_stages(spark, tmp_path):
    data = awkward_rows()
    table(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in data if not ((b := brute_quality(r[1]))[0] < 50 or 100 * b[4] > 50 * b[0])]
    docs = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert pairs(docs.collect()) == collections.Counter(r[:2] for r in kept) and docs.columns == corpus_pipeline.COLUMNS

    first = lambda i: -1 if i is None else i
    newest = {r[1]: r for r in sorted(kept, key=lambda r: first(r[0]))}
    kept = list(newest.values())
    docs = corpus_pipeline.materialise(corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)), "test")
    assert pairs(docs.collect()) == collections.Counter(r[:2] for r in kept)

    numbered = [(k, *r[1:]) for k, r in enumerate(sorted(kept, key=lambda r: (r[0] is None, r[0])))]
    component = {k[0]: k[2] for k in brute_components(numbered)}
    docs = corpus_pipeline.materialise(corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)), "test")
    number, ids = {r[1]: r[0] for r in numbered}, dict(enumerate(sorted((r[0] for r in kept), key=lambda i: (i is None, i))))
    got = docs.collect()
    assert len(got) < len(kept) and sorted(component[number[r["text"]]] for r in got) == sorted(set(component.values()))  # one of each
    assert all(r["doc_id"] == ids[component[number[r["text"]]]] for r in got)  # and its id is the least
    kept = [tuple(r) for r in got]

    units = [tuple(WORD.findall(r[1])) for r in kept]
    want = {}
    for r, w, marks in zip(kept, units, covered(units, 35)):
        if not all(marks):
            want[(r[0], r[1])] = r[1] if not any(marks) else " ".join(x for x, c in zip(w, marks) if not c)
    docs = corpus_pipeline.materialise(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "test")
    assert collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == collections.Counter((k[0], v, len(v)) for k, v in want.items())

    by_hand = collections.Counter(tuple(r)[:5] for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect())
    assert collections.Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == by_hand and by_hand


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
