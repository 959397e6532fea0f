"""Personal data: proposing, scoring and redacting spans.

Four base kinds are exact patterns and always stay.  Beside them, high-recall
generators propose further spans, which may overlap (secrets behind a key word,
long random strings, addresses written with "(at)" and "(dot)", local telephone
numbers, identity and account numbers).  Gradient-boosted trees score each
proposal from its format and its context; a proposal is taken if it reaches its
kind's threshold, which is calibrated for precision on held-out examples, if it
overlaps no base span and if no better proposal overlaps it.

The trees are trained on the driver from a generator of labelled examples with a
fixed seed and a fixed size (EXAMPLES), so the model's size is a constant; no
corpus text is needed.  The scan over texts is one streaming Arrow pass without
an exchange: a byte mask finds the texts that hold a digit, an at sign or a
spelled-out one (also " at "), and only those are searched, in time linear in their length.

Defined cases: a null or empty text has no spans; offsets are code points;
base spans of different kinds may overlap and all stay; repeated rows each get
their own result; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

KINDS = ("email", "ip", "card", "phone", "secret", "handle", "number")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns start at a digit run's first digit; where that fails, the run's other digits fail too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as in KINDS."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


_KEYED = re.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth|key)[ ]{0,3}[=:][ ]{0,3}["']?([A-Za-z0-9+/_-]{6,}+)["']?""")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\]| at )[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]| dot |\.)[ ]?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: kind, pattern, its group, and what every match has: a pattern is searched only near that.
GENERATORS = (("secret", _KEYED, 1, re.compile("[=:]")), ("secret", _RANDOM, 0, re.compile("[0-9]")), ("email", _SPELLED, 0, re.compile(r"\(at\)|\[at\]| at ")), ("phone", _LOCAL_PHONE, 0, re.compile("[0-9]")), ("number", _ID_NUMBER, 0, re.compile("[0-9]")), ("number", _ACCOUNT, 0, re.compile("[0-9]")))
#: More than the length of any match outside its run of secret characters; a pattern is searched so far around what it needs, and to both ends of the runs there.
REACH = 400
_RUN = re.compile(r"[A-Za-z0-9+/_-]*+")
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_CONTEXT = tuple(re.compile(p) for p in (r"(?i)(?:password|passwd|pwd|token|secret|key|auth)\W{0,6}$", r"(?i)(?:mail|contact|write to|reach)\W{0,6}$", r"(?i)(?:phone|call|tel|mobile|fax)\W{0,6}$", r"(?i)(?:ssn|social|account|iban|id|number|no)\W{0,6}$"))
_VOWELS = frozenset("aeiouAEIOU")
#: Endings of addresses that are told from words.
_ENDINGS = frozenset("com org net edu gov io info biz co uk de fr es it nl eu ch at us ca au".split())


def _near(text: str, need: re.Pattern) -> list[tuple[int, int]]:
    """The parts of the text within REACH of a match of `need`, grown to whole runs; a growth never goes over the same characters again."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := need.search(text, at):
        a, b = max(0, m.start() - REACH), m.start() + REACH
        at = m.end()
        if out and b <= out[-1][1]:
            continue
        if b < len(text):
            b = max(b, _RUN.match(text, b).end() + 2)  # a quote and what follows it
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
            continue
        while a and text[a - 1] in _RUN_CHARS:
            a -= 1
        out.append((a, b))
    return out


def propose(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end) of every proposal; they may overlap."""
    parts = {need: _near(text, need) for need in {g[3] for g in GENERATORS}}
    return [(g, *m.span(group)) for g, (_, pattern, group, need) in enumerate(GENERATORS) for a, b in parts[need] for m in pattern.finditer(text, a, b) if m.end() < b or b >= len(text)]


def describe(text: str, generator: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    s = text[start:end]
    n = len(s)
    digits, upper, lower = sum(c in "0123456789" for c in s), sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    letters = upper + lower
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    return [
        *(float(generator == g) for g in range(len(GENERATORS))),
        n, digits / n, letters / n, upper / n, turns / n, len(set(s)) / n,
        sum(c in _VOWELS for c in s) / max(letters, 1), sum(c in "-_/+" for c in s) / n, s.count(" "), float("(" in s or "[" in s), s.lower().count("dot"), float(re.split("[^a-z]+", s.lower().rstrip("])"))[-1] in _ENDINGS), s.count(". "),
        float(all(c in "0123456789abcdefABCDEF" for c in s)), float(before[-1:] in ("", " ", "\n", '"', "'", "=", ":", "(")), float(after[:1] in ("", " ", "\n", '"', "'", ".", ",", ";", ")")), *(float(bool(p.search(before))) for p in _CONTEXT),
    ]


#: Labelled examples made for training, and for calibration; trees, their depth, and their step.
EXAMPLES, CALIBRATION, TREES, DEPTH, STEP, PRECISION = 6000, 3000, 40, 3, 0.3, 0.99


def _example(rng: random.Random) -> tuple[str, bool]:
    """A short text that holds one marked string, and whether that is personal."""
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexes, low, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick(low, 2, 9)
    mixed = pick(low + low.upper() + digits, 20, 44)
    good = [
        lambda: f"{rng.choice(['password', 'passwd', 'pwd', 'token', 'secret', 'api_key', 'key'])}{rng.choice(['=', ': ', ' = '])}{rng.choice(['', chr(34)])}{pick(hexes, 8, 44)}",
        lambda: f"{rng.choice(['password', 'token', 'secret', 'auth'])}{rng.choice(['=', ': '])}{mixed}",
        lambda: pick(hexes, 32, 64),
        lambda: mixed,
        lambda: f"{word()}.{word()} {rng.choice(['(at)', '[at]'])} {word()} {rng.choice(['(dot)', '[dot]', 'dot'])} {rng.choice(['com', 'org', 'net'])}",
        lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}{rng.choice(['', '.' + word(), '_' + word()])} at {word()}.{rng.choice(['com', 'org', 'net', 'edu', 'io', 'de', 'co'])}",
        lambda: f"{rng.choice(['call', 'phone', 'tel', 'mobile', '', word()])} " + rng.choice(["({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(pick(digits, 3, 3), pick(digits, 3, 3), pick(digits, 4, 4)),
        lambda: f"{rng.choice(['ssn', 'social', 'id number', ''])} {pick(digits, 3, 3)}-{pick(digits, 2, 2)}-{pick(digits, 4, 4)}",
        lambda: f"{rng.choice(['iban', 'account', ''])} {pick('ABCDEFGHIKLNPST', 2, 2)}{pick(digits, 2, 2)} " + " ".join(pick(digits, 4, 4) for _ in range(rng.randint(3, 6))),
    ]
    poor = [
        lambda: f"{rng.choice(['key', 'token', 'secret', 'password'])}: {pick(low, 6, 12)}",
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))) + pick(low, 6, 6),
        lambda: pick(low, 16, 40),
        lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "tion", "ed"]) for _ in range(rng.randint(8, 14))),
        lambda: pick(low.upper(), 16, 30),
        lambda: "_" * rng.randint(16, 40),
        lambda: "-" * rng.randint(16, 40),
        lambda: pick(digits, 16, 30),
        lambda: f"/{word()}/{word()}/{word()}/{word()}/{word()}",
        lambda: f"{word()} at {word()}.{word()} {word()}",
        lambda: f"{word()} at {word()}. {word()}",
        lambda: f"{word()} at {rng.choice(['the', 'a', 'this', 'all', 'last', word()])}. {rng.choice(['The', 'It', 'He', 'And', word().title()])} {word()}",
        lambda: f"{pick(low, 1, 8)}1 at {word()} {word()}.{pick(digits, 1, 3)}",
        lambda: f"version {pick(digits, 3, 3)}.{pick(digits, 3, 3)}.{pick(digits, 4, 4)}",
        lambda: f"AB12 {pick('ABCDEFGH', 4, 4)} {pick('ABCDEFGH', 4, 4)}",
    ]
    label = rng.random() < 0.5
    inner = rng.choice(good if label else poor)()
    return f"{' '.join(word() for _ in range(rng.randint(0, 4)))} {inner}{rng.choice(['', ' ', '. ', ', '])}{' '.join(word() for _ in range(rng.randint(0, 4)))}", label


_PROSE = "the of and to in is that it was for on with as be by this have from or had not are but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def _other_example(rng: random.Random) -> tuple[str, bool]:
    """An example as of another hand: other words, formats and surroundings than `_example`'s, for the thresholds."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    some = lambda k: " ".join(rng.choice(_PROSE) for _ in range(k))
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    name = lambda: rng.choice(["anna", "li.wei", "j_smith", "omar77", "sales", "info", "m-keller", "kim"])
    host = lambda: rng.choice(["mail", "corp", "shop-online", "uni", "acme", "post", "web2"])
    good = [
        lambda: f"{rng.choice(['API_KEY', 'auth', 'Token', 'access-key', 'PASSWORD', 'pwd'])}={pick(letters.upper() + letters + digits, rng.randint(10, 60))}",
        lambda: f"{rng.choice(['secret', 'password'])}: '{pick(letters, 3)}{pick(digits, 4)}{pick(letters.upper(), 3)}'",
        lambda: f"sk_live_{pick(letters + letters.upper() + digits, rng.randint(16, 30))}",
        lambda: pick(digits + "ABCDEF", rng.choice([32, 40, 64])),
        lambda: f"{name()} {rng.choice(['(at)', '[at]'])} {host()} {rng.choice(['(dot)', '[dot]', 'dot'])} {rng.choice(['com', 'de', 'org'])}",
        lambda: f"{name()} at {host()}{rng.choice([' dot ', '.'])}{rng.choice(['com', 'net', 'org'])}",
        lambda: f"{rng.choice(['Tel.', 'ring', 'or', 'on'])} {rng.choice(['{0}-{1}-{2}', '({0}) {1}-{2}', '{0}.{1}.{2}', '{0} {1} {2}']).format(pick(digits, 3), pick(digits, 3), pick(digits, 4))}",
        lambda: f"{rng.choice(['SSN', 'his', 'with', 'no.'])} {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        lambda: f"{rng.choice(['IBAN', 'to', 'account'])} {rng.choice(['DE', 'FR', 'ES', 'NL'])}{pick(digits, 2)} {' '.join(pick(digits, 4) for _ in range(4))} {pick(digits, 2)}",
    ]
    poor = [
        lambda: f"{rng.choice(['key', 'token', 'secret'])}: {rng.choice(['important', 'because', 'everyone', 'something'])}",
        lambda: "-".join(rng.choice(_PROSE) for _ in range(6)) + "-2",
        lambda: f"{some(1)}/{some(1)}/{some(1)}/page/{rng.randint(1, 99)}/index",
        lambda: f"{some(1)} at {some(1)}. {some(1).title()} {some(1)}",
        lambda: f"{some(1)} at {rng.choice(['home', 'least', 'last', 'noon'])}.{some(1)}",
        lambda: "=" * rng.randint(16, 40) + pick(digits, 1),
        lambda: f"{pick(digits, 8)}-{pick(digits, 8)}",
        lambda: f"AA{pick(digits, 2)} {pick('ABCDEF', 4)} {pick('ABCDEF', 4)} {pick('ABCDEF', 4)}",
    ]
    label = rng.random() < 0.5
    return f"{some(rng.randint(0, 6))} {rng.choice(good if label else poor)()}{rng.choice(['', '.', ',', ' '])} {some(rng.randint(0, 6))}", label


def _examples(n: int, seed: int, example=None) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    x, y = [], []
    while len(y) < n:
        text, label = (example or _example)(rng)
        for g, a, b in propose(text):
            x.append(describe(text, g, a, b))
            y.append(label)
    return np.array(x), np.array(y, float)


class Trees:
    """Gradient boosting of small regression trees for the logistic loss, with Newton leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(len(y), int)  # node of each row in heap order
            split = np.full(2**DEPTH - 1, -1)
            value = np.zeros(2**DEPTH - 1)
            for node in range(2**DEPTH - 1):
                rows = np.flatnonzero(at == node)
                best, where = 1e-6, None
                g0, h0 = grad[rows].sum(), hess[rows].sum()
                for j, c in enumerate(cuts):
                    g = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))[:-1]
                    h = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(c) + 1))[:-1]
                    gain = g**2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0**2 / (h0 + 1)
                    if len(gain) and gain.max() > best:
                        best, where = gain.max(), (j, int(gain.argmax()))
                if where:
                    split[node], value[node] = where[0], cuts[where[0]][where[1]]
                    at[rows] = 2 * node + 1 + (binned[rows, where[0]] > where[1])
                else:
                    split[node] = 0
                    value[node] = np.inf
                    at[rows] = 2 * node + 1
            leaf = at - (2**DEPTH - 1)
            g = np.bincount(leaf, grad, 2**DEPTH)
            h = np.bincount(leaf, hess, 2**DEPTH)
            out = STEP * g / (h + 1)
            f += out[leaf]
            self.trees.append((split, value, out))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for split, value, out in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, split[at]] > value[at])
            f += out[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-f))


@functools.lru_cache(1)
def model() -> tuple[Trees, np.ndarray]:
    """The trees, and for each generator the least score that is redacted."""
    trees = Trees(*_examples(EXAMPLES, 1))
    x, y = _examples(CALIBRATION, 2, _other_example)
    p = trees.predict(x)
    limits = np.full(len(GENERATORS), 0.5)
    for g in range(len(GENERATORS)):
        own = x[:, g] == 1
        scores = np.unique(p[own])
        limits[g] = np.inf  # a generator that can't reach the precision proposes in vain
        for k, limit in enumerate(scores):
            if limit >= 0.5 and y[own & (p >= limit)].mean() >= PRECISION:
                below = scores[k - 1] if k else 0.0
                limits[g] = max(0.5, (below + limit) / 2)
                break
    return trees, limits


def added_spans(text: str, base: list[Span], trees: Trees, limits: np.ndarray) -> list[Span]:
    """The proposals that are taken."""
    found = propose(text)
    if not found:
        return []
    scores = trees.predict(np.array([describe(text, *c) for c in found]))
    good = sorted((-p, a, b, g) for (g, a, b), p in zip(found, scores, strict=True) if p >= limits[g])
    spans, starts, out = sorted((a, b) for _, a, b in _merged(base)), [], []
    starts = [a for a, _ in spans]
    for _, a, b, g in good:
        k = bisect.bisect_left(starts, b)
        if k and spans[k - 1][1] > a:
            continue
        spans.insert(k, (a, b))
        starts.insert(k, a)
        out.append((GENERATORS[g][0], a, b))
    return out


def _merged(spans: list[Span]) -> list[Span]:
    """Overlapping spans as one, of the first one's kind."""
    out: list[Span] = []
    for kind, a, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in _merged(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_TRIGGER = np.zeros(256, bool)
_TRIGGER[list(b"0123456789@=:([")] = True
_AT = re.compile(rb" at ")


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows whose text may hold a span: every pattern needs one of the triggers."""
    data, offsets = T.utf8(column)
    at = np.concatenate([np.flatnonzero(_TRIGGER[data]), np.fromiter((m.start() for m in _AT.finditer(data)), np.int64)])
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row the numbers and digest of its base spans, and all its spans."""
    trees, limits = model()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
            for row in _suspects(batch["text"]):
                x = batch["text"][int(row)].as_py()
                base = base_spans(x)
                every = sorted([*base, *added_spans(x, base, trees, limits)], key=_order)
                for kind, _, _ in base:
                    counts[KINDS.index(kind), row] += 1
                if base:
                    digests[row] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[row] = _join(every)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with all spans of the text replaced by their kind in brackets; n_chars follows the text."""
    trees, limits = model()
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            changed: dict[int, str] = {}
            for row in _suspects(texts):
                x = texts[int(row)].as_py()
                base = base_spans(x)
                if every := sorted([*base, *added_spans(x, base, trees, limits)], key=_order):
                    changed[int(row)] = redact(x, every)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                new = pa.array([changed[k] for k in sorted(changed)], texts.type)
                batch = batch.set_column(at, batch.schema.field(at), pa.compute.replace_with_mask(texts, pa.array(mask), new))
            yield batch

    out = docs.mapInArrow(run, schema)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(n_chars).isNotNull(), F.length(text).cast(schema[n_chars].dataType)))
    return out
