"""I2 counts tokens inside a document's row: no sort or shuffle of token rows, the same scores as the definition."""

import re
from collections import Counter

from quarry.operators import summarize as sm

TEXTS = [
    (1, "One fish. Two fish! Red fish? 12 34. Blue fish. Two fish! One, one, one and none"),
    (2, ""), (3, None), (4, "...!?"), (5, "42"), (6, "a b a. b a b. c"),
    (7, "Ärger über Öl. ärger ÜBER öl. Nichts"), (7, "Another text. Ärger über Öl. Its words"),
    (None, "No key here. Two sentences."), (8, " ".join(f"Word{'xyz'[i % 3]} w{i % 7} end." for i in range(60))),
]


def expected(texts):
    first = {}
    for text in texts:
        for pos, sent in enumerate(re.findall(r"[^.!?]+[.!?]?", text or "")):
            if sent.strip():
                first[sent.strip()] = min(pos, first.get(sent.strip(), pos))
    toks = [(pos, t) for sent, pos in first.items() for t in re.findall(r"[^\W\d_]+", sent.lower())]
    tf = Counter(t for _, t in toks)
    rows = []
    for pos in sorted(set(first.values())):
        mine = [tf[t] for p, t in toks if p == pos]
        rows.append((pos, max(s for s, p in first.items() if p == pos), sum(mine) * 1000 // len(mine) if mine else 0))
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    return {(*r, i + 1) for i, r in enumerate(order)}


def test_scores_by_definition(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    got = {}
    for r in sm.score_sentences(sm.sentences(df)).collect():
        got.setdefault(r["id"], set()).add((r["pos"], r["sentence"], r["score"], r["rank"]))
    want = {k: expected([t for i, t in TEXTS if i == k]) for k in {i for i, _ in TEXTS}}
    assert got == {k: v for k, v in want.items() if v}


def test_summary_joins_back_every_row(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    rows = sm.extractive_summary(df).collect()
    assert sorted(str(r["id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    for r in rows:
        best = expected([t for i, t in TEXTS if i == r["id"]]) if r["id"] is not None else set()
        assert r["n_sentences"] == (len(best) or None)
        assert r["summary"] == (" ".join(s for _, s, _, k in sorted(best) if k <= 2) or None)
        assert r["detailed_summary"] == (" ".join(s for _, s, _, k in sorted(best) if k <= 5) or None)


def test_tokens_are_no_rows(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    plan = sm.extractive_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert plan.count("Generate ") == 1                  # of sentences
