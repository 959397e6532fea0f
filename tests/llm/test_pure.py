"""Parts of the operators that need no session, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text as T
from tessera.llm import bitsliced, chat, decontaminate, packing, pii, quality, suffix, tokens
from tessera.llm.queries import tokenizer_path


def test_chat_round_trip():
    t = chat.Template()
    for role in ("user", "assistant", "tool", "", "a:b\\c", "x### </turn>"):
        for text in ("", "a", "\\### Assistant: </turn> ok", "####  </tur", "\\", "\\\\###", "</turn>\n### User: hi</turn>\n", "é\n" * 500):
            assert t.parse("".join(s for _, s, _ in t.segments(role, text)))[:2] == (role, text)


def test_tiles_find_reordered_passages():
    a, b = list(range(100, 120)) + list(range(20)), list(range(20)) + list(range(100, 120))
    assert sorted(n for _, _, n in decontaminate.tiles(a, b)) == [20, 20]
    assert decontaminate.tiles([], b) == [] and decontaminate.tiles(a, [1]) == []
    assert decontaminate.tiles([7] * 12, [7] * 6) == [(0, 0, 6)]


def test_leaks_by_coverage():
    words = [f"w{i}" for i in range(40)]
    index = decontaminate.Index.build([5, 6], [" ".join(words), "too short here"])
    half = " ".join(["x"] * 30 + words[20:] + ["y"] * 9 + words[:20])
    got = list(decontaminate.leaks(pa.array([half, "W0, w1; w2", None, "", " ".join(words).upper()]), index))
    assert [(r, i, c) for r, i, _, c, _, _ in got] == [(0, 0, 40), (4, 0, 40)]


def test_suffix_order_and_common_prefixes():
    r = random.Random(3)
    for _ in range(500):
        t = bytes(r.randint(1, r.choice([1, 2, 3, 5, 40])) for _ in range(r.randint(1, r.choice([5, 60, 200])))) + b"\0"
        cap, memory = r.choice([2, 3, 20, 200]), r.choice([4, 8, 50, 10**4]) * suffix.TUPLE  # buckets of 4 and more suffixes, so that characters are streamed too
        got = list(suffix.suffixes(np.frombuffer(t, np.uint8), 8, np.bincount(np.frombuffer(t, np.uint8)), cap, memory))
        order, common = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        assert sorted(order) == list(range(len(t)))
        keys = [t[i : i + cap] for i in order]
        assert keys == sorted(keys, reverse=True)
        for a, b, c in zip(order[:-1], order[1:], common[1:], strict=True):
            n = next((k for k in range(cap) if t[a + k : a + k + 1] != t[b + k : b + k + 1]), cap)
            assert c == n


def test_a_shard_larger_than_its_memory():
    import tracemalloc

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    passage = " ".join(r.choice(words) for _ in range(60)).encode()
    raw = b"".join(" ".join(r.choice(words) for _ in range(3000)).encode() + passage for _ in range(60))
    tracemalloc.start()
    with suffix.Shard(100, 8_000_000) as shard:
        for a in range(0, len(raw), 100_000):
            shard.add(np.frombuffer(raw[a : a + 100_000], np.uint8))
        got = np.concatenate([p for p, _ in shard.runs()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen, want = {}, set()
    for i in range(len(raw) - 99):
        seen.setdefault(raw[i : i + 100], []).append(i)
    want = {i for same in seen.values() if len(same) > 1 for i in same}
    assert set(got.tolist()) == want and len(got) == len(want)
    # 15 bytes a suffix in each of four queues, and 20 bytes a star, would be over 100 MB if they were in memory
    assert peak < 45_000_000


def test_bit_sliced_top_is_exact_with_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (700, 9))
    ids = rng.permutation(700) * 3
    index = bitsliced.Index(ids, x)
    for row in range(0, 700, 50):
        got, scores = index.top(int(ids[row]), x[row], 20)
        s = x @ x[row]
        want = sorted((-int(s[k]), int(ids[k])) for k in range(700) if k != row)[:20]
        assert [(-int(a), int(b)) for a, b in zip(scores, got, strict=True)] == want
    assert len(bitsliced.Index(np.array([4]), x[:1]).top(4, x[0], 20)[0]) == 0


ODD = ["a", "B", " ", "  ", "\n", "\t", "\xa0", "　", "é", "É", "é", "'s", "'S", "'", "<|endoftext|>", "<|endof", "text|>", "1", "2", "!", "\x1c", "\x85", "日", " ", "ß ", "Σ", "İ", "\x7f", "\x00", "ﬁ"]


def test_counts_and_ids_are_the_librarys():
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokenizer_path(name)
        want = [x.ids for x in tokens.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if name.startswith("byte"):
            assert tokens.count_column(path, pa.array(texts)).tolist() == [len(x) for x in want]
        else:
            assert [x.tolist() for _, x in packing.ids_of(pa.array(texts), path, 2)] == [[*x, 2] for x in want]


def test_unit_table_starts_anew_with_the_same_ids():
    r = random.Random(5)
    path = tokenizer_path("word_bpe_49k.json")
    table = tokens.UnitTable(path, packing.solid_units, keep=40)
    most = 0
    for _ in range(60):
        words = ["".join(r.choice("abcxyz019") for _ in range(r.randint(1, 5 if r.random() < 0.95 else 900))) for _ in range(r.randint(1, 30))]
        data, offsets = T.utf8(pa.array([" ".join(words)]))
        begin, sizes = table.look_up(data, *packing.solid_units(data, offsets)[:2])
        got = [table.ids[a : a + n].tolist() for a, n in zip(begin, sizes, strict=True)]
        assert got == [tokens.tokenizer(path).encode(w, add_special_tokens=False).ids for w in words]
        most = max(most, len(table.keys))
    assert 20 < most <= 40


def test_unit_table_never_gathers_its_ids_anew():
    import tracemalloc

    r = random.Random(6)
    path = tokenizer_path("word_bpe_49k.json")
    texts = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(1000)) for _ in range(300)]
    column = pa.array(texts)
    list(packing.ids_of(column.slice(0, 1), path, 2))  # the tokenizer and the powers of the hashes stay
    tokens._tables.clear()
    tracemalloc.start()
    n = sum(len(x) for _, x in packing.ids_of(column, path, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 300_000 and len(tokens._tables[path, "solid_units"].keys) > 290_000
    # 11 MB of table and 2 MB of texts; with ids moved by an index for each one, and 2 MB of text at a time, it was 173 MB
    assert peak < 40_000_000


def test_quality_statistics_work_on_short_stretches():
    import tracemalloc

    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(1000)) for _ in range(800)]
    data, offsets = T.utf8(pa.array(texts))
    want = np.concatenate([quality.features(*T.sub(data, offsets, k, k + 1)) for k in range(0, 800, 40)])
    tracemalloc.start()
    got = quality.features(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[::40] == want).all()
    # 4 MB of text; 2 MB of it at a time take more
    assert peak < 25_000_000


def test_plan_places_every_piece_once():
    r = random.Random(2)
    for _ in range(30):
        h = {r.randint(1, 64): r.randint(1, 200) for _ in range(r.randint(0, 40))}
        groups = packing.plan(h, 64)
        placed = Counter()
        for g in groups:
            assert sum(n * k for n, k in g.parts) == g.used <= 64
            for n, k in g.parts:
                placed[n] += k * g.count
        assert placed == Counter(h)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text):
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(pii._digits(s)) <= 19 and pii.luhn(pii._digits(s)), "phone": lambda s: 9 <= len(pii._digits(s)) <= 15}
    return sorted(((k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])), key=pii._order)


def test_base_spans_are_the_patterns():
    r = random.Random(5)
    for _ in range(20000):
        text = "".join(r.choice("aé@..+-  012345()\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == _base(text)
    assert pii.base_spans("a" * 200_000 + "@") == []


def test_long_secrets_are_whole():
    trees, limits = pii.model()
    r = random.Random(8)
    for n in (200, 201, 400, 900, 5000):
        value = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
        for before, after in (("token=", " and more"), ('secret: "', '" and more'), ("prose ", " and more"), ("prose ", "")):
            text = "plain words " * 50 + before + value + after
            assert pii.redact(text, pii.added_spans(text, [], trees, limits)) == "plain words " * 50 + before + "[SECRET]" + after
    late = "plain words " + "abcdefgh" * 100 + "7" + "abcdefgh" * 100 + " more"  # the only digit is far from both ends
    assert (1, 12, 12 + 1601) in pii.propose(late)
    assert [(a, b) for _, a, b in pii.propose("x1" * 200_000)] == [(0, 400_000)]


def test_added_spans_and_redaction():
    trees, limits = pii.model()
    text = 'a token = "97ffa88d7c5f5655e365004e29bd123cdabd722a" b joe@x.org password=7602ad27cf5550de1c plain words of prose'
    base = pii.base_spans(text)
    spans = sorted([*base, *pii.added_spans(text, base, trees, limits)], key=pii._order)
    assert [k for k, _, _ in spans] == ["secret", "email", "secret"]
    assert pii.redact(text, spans) == 'a token = "[SECRET]" b [EMAIL] password=[SECRET] plain words of prose'
    x, y = pii._examples(1500, 99)
    taken = trees.predict(x) >= limits[x[:, : len(limits)].argmax(1)]
    assert y[taken].mean() > 0.97 and taken[y == 1].mean() > 0.9


def test_quality_separates_held_out_rows():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "river", "runs", "over", "stones", "and", "sings."], 60)) for _ in range(300)]
    bad = [" ".join(f"{w}!!" for w in rng.choice(["BUY", "NOW", "CHEAP"], 60)) for _ in range(60)]
    x = quality.features(*quality.T.utf8(pa.array([*good, *bad, "", None])))
    sums = np.zeros((2, 1 + quality.N_FEATURES + quality.N_FEATURES**2))
    for k, part in ((1, x[:200]), (0, x[300:340])):
        sums[k] = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    score = quality.model_from_sums(sums).score(x)
    assert score[200:300].min() > 0.5 > score[340:360].max() and np.isfinite(score).all()
    assert np.isfinite(quality.model_from_sums(np.zeros_like(sums)).score(x)).all()


def test_spelled_out_addresses_stand_for_themselves():
    trees, limits = pii.model()

    def taken(text):
        return [text[a:b] for _, a, b in pii.added_spans(text, pii.base_spans(text), trees, limits)]

    alone, marked = "please ask joe at example.com about it", "please ask joe at example.com about it (at) some dot other place"
    assert taken(alone) == ["joe at example.com"] and "joe at example.com" in taken(marked)
    assert pii._suspects(pa.array([alone, "nothing here", None, "x"])).tolist() == [0]
    assert taken("look at this. The end is near. We met at noon. Then we left.") == []


def test_added_spans_by_kind_on_examples_of_another_hand():
    trees, limits = pii.model()
    assert np.isfinite(limits).all()
    x, y = pii._examples(2000, 77, pii._other_example)
    p = trees.predict(x)
    for g in range(len(pii.GENERATORS)):
        own = x[:, g] == 1
        good = own & (p >= limits[g])
        assert y[good].mean() >= 0.97 and good[y == 1].sum() >= 0.75 * (own & (y == 1)).sum()
