"""The operators on small tables against brute force: nulls, empty texts, ties, repeated rows, empty tables, other columns."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced, chat, decontaminate, neardup, packing, pii, quality, substring, suffixdedup, tokens
from tessera.llm.queries import PROBE, tokenizer_path

DOCS = "doc_id long, text string, lo string, key long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(parts)


def mixed(seed, pieces, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, "".join(r.choice(pieces) if r.random() < 0.6 else "".join(r.choice("abcdefghij ") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 5)))))
    return [*rows, (900, None), (901, ""), (902, "Heat " * 400), (903, "Heat " * 19), (904, "a" * 3000), (905, " \t\n")]


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", PROBE), (2, 0, "assistant", PROBE), (2, None, None, "x"), (None, 1, "user", "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(conv)).collect()}
    assert {k: (r.n_turns, r.loss_chars, r.valid_order) for k, r in got.items()} == {1: (2, 0, True), 2: (3, 2 * len(PROBE), False), None: (1, 0, True)}
    assert chat.read_back(chat.format_chats(conv.limit(0))).count() == 0


def test_suffix_dedup(spark):
    r = random.Random(1)
    rows = mixed(1, ["".join(r.choice("abé d") for _ in range(r.randint(60, 260))) for _ in range(6)])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdedup.digest(suffixdedup.remove(frame(spark, rows))).collect()}
    assert got == suffixdedup.reference(rows)


@pytest.mark.parametrize("parts", [4, 50])
def test_suffix_dedup_of_anchors_with_many_pieces(spark, parts, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 0)
    seen = []
    monkeypatch.setattr(suffixdedup, "windows", lambda joined, window, f=suffixdedup.windows: seen.append(1) or f(joined, window))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    r = random.Random(9)
    line, long_line = "a line that very many texts share, word by word", "".join(r.choice("abcdefgh ") for _ in range(140))
    rows = [(i, "".join(r.choice("mnop ") for _ in range(r.randint(0, 80))) + r.choice([line, long_line]) + "".join(r.choice("qr ") for _ in range(r.randint(0, 60)))) for i in range(60)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdedup.digest(suffixdedup.remove(frame(spark, rows))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == suffixdedup.reference(rows) and seen


def test_substring_dedup(spark):
    r = random.Random(2)
    rows = mixed(2, [" ".join(r.choice("abcdef") for _ in range(r.randint(5, 50))) + " " for _ in range(6)])
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.digest(substring.remove(frame(spark, rows))).collect()}
    assert got == substring.reference(rows)


@pytest.mark.parametrize("operator", [suffixdedup.remove, substring.remove])
def test_repeats_of_odd_rows(spark, operator):
    same = " ".join(f"w{i}" for i in range(60))
    rows = frame(spark, [(7, same), (7, same), (None, same), (8, same)])
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in operator(rows).collect())
    assert got == [("7", False), ("7", False), ("8", True), ("None", False)]
    assert operator(rows.limit(0)).count() == 0


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    sets, of = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (c := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark):
    r = random.Random(4)
    base, rows = [f"w{j}" for j in range(60)], []
    for i in range(90):  # a group at all similarities, whose members share tables
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{j}" for j in range(80)]
    for i in range(30):
        chain[i] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000, ""), (2001, None), (2002, "A b"), (2003, "a  B"), (2004, "a"), (2005, " ".join(base))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.cluster(frame(spark, rows)).collect()}
    assert got == _components(rows)
    kept = neardup.dedup(frame(spark, [*rows, (None, "z")]))
    assert kept.columns == ["doc_id", "text", "lo", "key"] and kept.count() == len({v[1] for v in got.values()}) + 1
    assert neardup.cluster(frame(spark, rows).limit(0)).count() == 0


def test_rare_pairs_lose_no_pair(spark):
    r = random.Random(6)
    sets = {i: sorted(r.sample(range(20), r.randint(1, 12))) for i in range(60)}
    rows = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "rep long, n long, c long")
    items = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    got = {(x.a, x.b) for x in neardup.rare_pairs(rows, items).collect()}
    for a in sets:
        for b in sets:
            c = len(set(sets[a]) & set(sets[b]))
            assert a >= b or 100 * c < 75 * (len(sets[a]) + len(sets[b]) - c) or (a, b) in got


def test_token_counts_of_texts_without_an_id(spark):
    rows = [(None, "a" * 700), (None, "b" * 900), (None, "a" * 700), (1, "a" * 700), (None, "word " * 100), (None, "short"), (None, None)]
    path = tokenizer_path("byte_bpe_50k.json")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens) for x in tokens.count(frame(spark, rows), path, chunk=200, overlap=100).collect())
    assert got == sorted((str(i), len(t or ""), len(tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_token_counts_with_spliced_chunks(spark):
    r = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "the ", "　 ", "é", "'s", "'", "<|endoftext|>", "1", "23", "!", "word "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 700))) for _ in range(20)] + ["a" * 700, " " * 700, "<|endoftext|>" * 60, "", None]
    path = tokenizer_path("byte_bpe_50k.json")
    got = {x.doc_id: (x.n_bytes, x.n_tokens) for x in tokens.count(frame(spark, list(enumerate(texts))), path, chunk=200, overlap=100).collect()}
    assert got == {i: (len((t or "").encode()), len(tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bucket", [1000, 3])
def test_packing(spark, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(0, 90)))) for i in range(60)] + [(99, None)] + [(200 + i, "alpha beta") for i in range(40)]
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(frame(spark, rows), path, 2, 64).collect()
    ids = {i: [*tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    parts, filled = {}, {}
    for x in got:
        parts.setdefault(x.doc_id, []).append((x.start, x.length))
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
        piece = ids[x.doc_id][x.start : x.start + x.length]
        assert zlib.crc32(b"".join(v.to_bytes(4, "little") for v in piece)) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
    for spans, end in [*((p, len(ids[i])) for i, p in parts.items()), *((f, None) for f in filled.values())]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == end if end else at <= 64
    assert sorted(parts) == sorted(ids)
    assert sum(map(len, ids.values())) > 0.85 * 64 * len(filled)
    assert packing.pack(frame(spark, rows).limit(0), path, 2, 64).count() == 0


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0]), (5, [-0.51, 3.0]), (6, []), (7, [1.0, 2.0]), (40, [float("inf"), 0.0])]
    v = bitsliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("s")))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.top_k(v, v.where("vec_id % 20 = 0"), 2, 2, 1).orderBy("query_id", "rank").collect()]
    s = 64 * 64 * 5
    near = 64 * -33 + 128 * 192
    want = [(0, 1, 5, near), (0, 2, 7, s)] if near > s else [(0, 1, 7, s), (0, 2, 20, s)]
    assert got[:2] == want and len(got) == 4


def test_decontamination_keeps_clean_rows_whole(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20))), (2, None), (3, "")], "item_id long, text string")
    rows = frame(spark, [(1, "clean words only " * 9), (2, " ".join(f"b{i}" for i in range(20)) + " tail"), (3, None), (4, "")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(rows, bench).collect()} == {(2, 1)}
    left = decontaminate.clean(rows, bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4] and left.columns == rows.columns
    assert decontaminate.find(rows, bench.limit(0)).count() == 0


def _tiled(a, b, least=5):
    """Greedy string tiling by definition: again and again the longest matches of free tokens, in order."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                out += best


def test_decontamination_against_tiling_by_definition(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randint(0, 400)}"
    items = [(k, [word() for _ in range(r.randint(5, 40))]) for k in range(12)] + [(50, ["yes", "no"]), (51, items_51 := ["the", "same", "five", "words", "here"] * 3), (51, items_51)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(r.randint(0, 4)):
            out += [word() for _ in range(r.randint(0, 20))]
            w = r.choice(items)[1]
            k = r.randint(0, len(w))
            out += r.choice([w, w[k:] + w[:k], w[k:], w[:k] + ["x"] + w[k:]])
        docs.append((i, out))
    docs += [(100, ["Yes,", "no!"]), (101, ["yes", "no", "no"]), (102, ["the", "same", "five", "words", "here"] * 200), (102, ["yes"]), (103, [])]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string").withColumn("coverage", F.lit(2.0))
    got = sorted((x.doc_id, x.item_id, x.covered_tokens) for x in decontaminate.find(frame(spark, [(i, " ".join(w)) for i, w in docs]), bench).collect())
    want = []
    for i, w in docs:
        plain = [x.lower().strip(",!") for x in w]
        for k, item in items:
            covered = _tiled(plain, item) if len(item) >= 5 else len(item) * (plain == item)
            if item and covered >= len(item) / 2:
                want.append((i, k, covered))
    assert got == sorted(want)


def test_redaction_keeps_rows(spark):
    rows = frame(spark, [(1, "mail joe@x.org now"), (2, None), (3, "plain")]).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(rows).collect()}
    assert got == {1: ("mail [EMAIL] now", 16), 2: (None, None), 3: ("plain", 5)}
    assert pii.find(rows.limit(0)).count() == 0


def test_quality_fit_ignores_held_out_labels(spark):
    rows = frame(spark, [(i, ("calm river stones and sand. " if i % 3 else "BUY!! NOW!! ") * (5 + i % 4)) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, None)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    v = quality.vectors(rows)
    a, b = (quality.fit(v, x) for x in (labels, flipped))
    assert abs(a.means - b.means).max() < 1e-12
    got = {r.doc_id: r.score for r in quality.score(v, a).collect()}
    assert all((s >= 0.3) == (i % 3 > 0) for i, s in got.items())
