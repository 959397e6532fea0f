"""The pipeline against its stages' own rules on the smallest tables, and against a plain version of every stage."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, packing, pii, quality, tokens
from tessera.llm._session import table
from tessera.llm.queries import tokenizer_path
from tests.llm.test_spark import _components, _tiled

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents")
    all_ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns, name
        assert {r.doc_id for r in docs.collect()} <= all_ids
    assert decontaminate.find(docs, table(spark, DATA, "benchmark")).count() == 0
    assert all(not pii.base_spans(r.text) for r in docs.collect())
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "benchmark_decontamination", "pii_redaction", "sequence_packing"]


def _statistics(text):
    """The classifier's vector of one text, character by character."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not words:
        return [0.0] * quality.N_FEATURES
    share = lambda chars: math.sqrt(sum(c in chars for c in b) / len(b))
    of = lambda n: math.sqrt(n / len(words))
    upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / len(words)), share(upper), share(b"0123456789"), share(b"#$%&*<>{}[]\\^~=_@/"), share(b".?"), share(b",;:"), math.sqrt(sum(c >= 128 for c in b) / len(b)),
        of(sum(len(w) == 1 for w in words)), len(set(words)) / len(words), of(sum(x == y for x, y in zip(words, words[1:], strict=False))), of(sum(w[0] in upper for w in words)), math.log1p(len(b) / (b.count(b"\n") + 1)), share(b"!"), share(b"|"),
    ]


def _quality(docs, labels):
    """The score of every text by the textbook's densities, without factors or running sums."""
    x = {i: np.array(_statistics(t)) for i, t in docs}
    train = [(x[i], q) for i, q in labels if i in x and q is not None and zlib.crc32(str(i).encode()) % 5]
    rows = [np.array([v for v, q in train if q == k]) for k in (0, 1)]
    means, own = [r.mean(0) for r in rows], [np.cov(r.T, bias=True) for r in rows]
    pooled = sum(len(r) * c for r, c in zip(rows, own, strict=True)) / len(train)
    log = [math.log(len(r) + 0.5) for r in rows]
    out = {}
    for i, v in x.items():
        density = []
        for k in (0, 1):
            cov = 0.8 * own[k] + 0.1 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(v))
            d = v - means[k]
            density.append(-0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]) + log[k])
        out[i] = 1 / (1 + math.exp(-max(-500, min(500, density[1] - density[0]))))
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, copies, benchmark passages, personal data, repeated labels and another column."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    items = [(k, prose(30)) for k in range(3)] + [(9, None)]
    docs, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        text = " ".join(prose(r.randint(8, 20)) for _ in range(4)) if good else "BUY!! NOW!! " * r.randint(4, 12) + "".join(r.choice("#$%|@0123456789 ") for _ in range(60))
        docs.append((i, text))
        if i < 90:
            labels.append((i, int(good)))
    base = docs[1][1]
    docs += [(200, base), (201, base + " tail"), (202, base), (203, docs[4][1] + " " + items[0][1]), (204, f"Write to me@example.org soon. {prose(40)} {prose(20)}"), (205, None), (206, ""), (207, prose(900))]
    labels += [(1, 1), (2, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def test_quality_against_the_densities(spark, small):
    folder, docs, labels, _ = small
    v = quality.vectors(table(spark, folder, "documents"))
    got = {r.doc_id: r.score for r in quality.score(v, quality.fit(v, table(spark, folder, "labels"))).collect()}
    want = _quality(docs, labels)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert quality.score(v.limit(0), quality.fit(v, table(spark, folder, "labels"))).count() == 0


def test_run_against_a_plain_version(spark, small):
    folder, docs, labels, items = small
    score = _quality(docs, labels)
    kept = [(i, t) for i, t in docs if score[i] >= 0.3]
    groups = _components(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    kept = [(i, t) for i, t in kept if not any(t_ and _tiled(split(t), split(t_)) >= len(split(t_)) / 2 for _, t_ in items)]
    trees, limits = pii.model()

    def plain(t):
        spans = pii.base_spans(t or "")
        for kind, a, b in sorted([*spans, *pii.added_spans(t or "", spans, trees, limits)], key=lambda s: -s[1]):
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        return t

    tokenizer = tokens.tokenizer(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(plain(t) or "", add_special_tokens=False).ids, 2] for i, t in kept}
    assert 204 in ids and not {200, 201, 202, 203, 0, 3} & ids.keys()
    rows = corpus_pipeline.run(spark, folder).collect()
    pieces, places = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, whole in [*((p, len(ids[i])) for i, p in pieces.items()), *((p, None) for p in places.values())]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == whole if whole else at <= 4096


def test_stages_on_an_empty_table(spark, small):
    docs = table(spark, small[0], "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, small[0])
        assert out.count() == 0 and (name == "sequence_packing" or out.columns == docs.columns)
    model = quality.model_from_sums(np.zeros((2, 1 + quality.N_FEATURES + quality.N_FEATURES**2)))
    assert quality.keep(docs, model, 0.3).count() == 0 and packing is not None
