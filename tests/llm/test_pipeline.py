"""The stages of corpus_pipeline, each on its own input, against plain versions."""

import random
import re

import pytest
from conftest import SF
from test_numbered import brute_classes, brute_repeats

import corpus_pipeline
from latticework.llm import jaccard_join
from latticework.llm.quality_model import quality
from latticework.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, scratch.table(stage(spark, out[-1][1], SF), name)))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for name, df in stages.items() if name != "best_fit_packing")


def test_quality(spark, stages):
    kept = {r.doc_id for r in quality(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(texts(stages["quality_classifier"])) == kept and kept


def test_near_duplicates(stages):
    before, after = texts(stages["quality_classifier"]), texts(stages["ngram_jaccard_join"])
    want = {i for i, (n, c) in brute_classes(sorted(before.items()), 5, 80).items() if c == i}
    assert set(after) == want and all(before[i] == t for i, t in after.items())


def test_near_duplicates_of_many_blocks(spark, monkeypatch):
    """A cell of several blocks, few of which have sets of more than 64 shingles."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    g = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    opening, rows = [g.choice(words) for _ in range(66)], []
    for i in range(90):
        text = opening + [g.choice(words) for _ in range(4 if i in (7, 50) else g.choice([0, 1, 2]))]
        text[g.randrange(66)] = f"own{i}"
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (n, c) in brute_classes([r[:2] for r in rows], 5, 80).items() if c == i}
    got = texts(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert got == {r[0]: r[1] for r in rows if r[0] in want} and len(want) < len(rows)


def test_repeated_passages(stages):
    before, after = texts(stages["ngram_jaccard_join"]), texts(stages["suffix_array_dedup"])
    want = brute_repeats([(i, t or "") for i, t in before.items()], 100)
    assert {i: (t or "") for i, t in after.items()} == {i: kept.decode("utf-8", "ignore") for i, (_, _, _, kept) in want.items()}


def test_personal_data(stages):
    before, after = texts(stages["suffix_array_dedup"]), texts(stages["pii"])
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert set(before) == set(after) and any(mail.search(t) for t in before.values()) and not any(mail.search(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not re.search(r"[@+0-9]", t))


def test_packing(stages):
    rows = stages["best_fit_packing"].collect()
    assert {r.doc_id for r in rows} == set(texts(stages["pii"]))
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, _doc long, _id long, _tag long, _text long, _bucket long, _place long, kept string, n_removed long"


def test_stages_on_odd_rows(spark):
    """Nulls, empties, repeats, genuine replacement characters, clashing columns: each stage keeps what it should as it was; empty tables stay empty."""
    g = random.Random(6)
    passage = "".join(g.choice("abcdefgh") for _ in range(220))
    # the last byte of é and ũ is the same, so the passage repeats from the middle of ũ on
    texts = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "\ufffd kept \ufffd é" + passage), (4, "ũ" + passage + " \ufffd"), (4, "ũ" + passage + " \ufffd"), (5, "x" * 200_000), (6, "mail a@b.org"), (7, "\ufffd")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 1, 2, 3, 4, 5, 6, "k", 7) for i, t in texts], ODD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = stage(spark, docs, SF)
        if name == "best_fit_packing":
            assert {r.doc_id for r in got.collect()} == {i for i, _ in texts}
            continue
        assert got.columns == docs.columns
        rows = got.collect()
        assert all((r._doc, r._id, r._tag, r._text, r._bucket, r._place, r.kept, r.n_removed) == (1, 2, 3, 4, 5, 6, "k", 7) for r in rows)
        if name == "ngram_jaccard_join":
            assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 2, None, None, 3, 4, 5, 6, 7]))
        if name == "suffix_array_dedup":
            by = {r.doc_id: r.text for r in rows}
            assert len(rows) == 10 and by[3] == texts[4][1] and by[7] == "\ufffd" and by[4] == " \ufffd" and by[6] == "mail a@b.org"
        if name == "pii":
            by = {r.doc_id: r.text for r in rows}
            assert len(rows) == 10 and by[6] == "mail [EMAIL]" and by[1] is None and by[2] == "" and by[3] == texts[4][1]


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["best_fit_packing"].count()
