"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns give the base spans.  The field tags every token as outside a
secret, its begin or its inside, from the token's shape, the tokens beside it
and features of the whole text, and is decoded by Viterbi.  Its spans are added
where they touch no base span.

Fitting.  The labels come from the patterns, but the field must not learn the
patterns: a secret's window comes as it is, and once for each of several alphabets
with the words that gave it away replaced and the secret drawn anew, of another
length and half the time with the marks that many kinds of secrets have.
Windows without secrets are from the middle of a text and around its longest
token with a digit; windows with a token that looks drawn at random but is in no
base span teach nothing, as it may be what the patterns miss.  What such windows
would teach is drawn instead: ordinary tokens that look like secrets (addresses,
paths, book and account numbers, versions, identifiers, UUIDs; `ordinary.KINDS`)
stand where a secret might, tagged as outside.  Maximum likelihood (forward-backward, Adam) on the windows
of at most `SAMPLE` different texts, at most `PER_DOC` secrets a text and
`WINDOWS` windows of `WINDOW` tokens in all, which is what reaches the driver.

Decoding looks at all tokens.  A run of tokens can only be a secret if the sum
of (score over outside + the most that transitions can add) is not negative;
tokens in no such run are outside in the best path, so Viterbi runs over the
others alone and finds the path that it would find over the whole text.

Rules for odd rows: a null text counts as empty and has no span; repeated rows
and null ids are each judged by their text; very long texts are one chain; an
empty table gives no rows; without any base span in the sample no span is added.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import distinct_sample, ship, sole_cache, trim
from docgauge.llm.ordinary import KINDS as KINDS_OF_ORDINARY
from docgauge.llm.ordinary import ordinary

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
TOKEN = re.compile(r"[\w+/.-]+=*|[^\w\s]")
SAMPLE, PER_DOC, WINDOWS, WINDOW, NEIGHBOURS = 20_000, 4, 8_000, 25, 48
#: Windows with ordinary tokens for each secret.
PER_SECRET = 5
#: Alphabets that secrets are drawn anew from.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, sorted."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves are within the base spans."""
    return sorted({m.span(2) if k == 0 and (m := ASSIGN.match(text, a)) else (a, b) for a, k, b in base_spans(text)})


class _Kinds(dict):
    """For str.translate: the kind of each character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else "."
        return kind


_KINDS = _Kinds()
_HEX = "0123456789abcdef"


def _is_hex(token: str) -> bool:
    return not token.lower().strip(_HEX)


_CONSONANTS = re.compile("[b-df-hj-np-tv-xz]+")


def _unspoken(token: str) -> int:
    """The most consonants in a row, 6 at most; words have few."""
    return min(6, max(map(len, _CONSONANTS.findall(token.lower())), default=0))


def shape(token: str) -> list[str]:
    """A token's features but for its word; they follow from all its characters' kinds, from whether all are hexadecimal and from its consonants."""
    kinds, n = token.translate(_KINDS), len(token)
    runs = 1 + sum(x != y for x, y in zip(kinds, kinds[1:]))
    classes = set(kinds)
    between = kinds.split(".")
    mixed = max((len(p) for p in between if "0" in p and ("a" in p or "A" in p)), default=0)
    changes = max(sum(x != y for x, y in zip(p, p[1:])) for p in between)
    return [
        f"length {min(n, 64) // 4}",
        "classes " + "".join(sorted(classes)),
        f"runs {min(runs, 12)}",
        f"runs by length {round(4 * runs / n)} {n >= 12}",
        f"digits {round(8 * kinds.count('0') / n)} {n >= 12}",
        f"letters and digits {'0' in classes and bool(classes & {'a', 'A'})} {min(n // 8, 2)}",
        f"hex {min(n, 64) // 8 if _is_hex(token) else '-'}",
        f"ends {kinds[:1]}{kinds[-1:]}",
        f"consonants {_unspoken(token)} {min(n, 24) // 6}",
        f"marks {min(len(between) - 1, 6)}",
        f"mixed between marks {min(mixed, 40) // 4}",
        f"changes between marks {min(changes, 12)} {min(mixed, 40) // 8}",
    ]


def beside(token: str, words: dict[str, int]) -> list[str]:
    """What a token tells about those next to it."""
    low = token.lower().strip(".")
    return ["word " + (low if low in words else "*"), "mark " + (token if len(token) == 1 and not token.isalnum() else "*")]


def of_file(text: str) -> list[str]:
    """Features of the whole text."""
    n = max(1, len(text))
    signs = sum(map(text.count, "={};"))
    return [f"signs {min(6, int(1000 * signs / n))}", f"digits {min(4, sum(map(text.count, '0123456789')) * 20 // n)}", f"size {min(8, n.bit_length() // 2)}"]


@dataclass
class Field:
    """Weights of begin and inside against outside, by the feature's name and place; transitions; the words that count as neighbours."""

    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]
    words: dict[str, int]

    def score(self, names: list[str]) -> tuple[float, float]:
        found = [self.weights[x] for x in names if x in self.weights]
        return sum(x for x, _ in found), sum(y for _, y in found)

    def slack(self) -> float:
        """Twice the most that one transition within a secret has over one without."""
        m = self.moves
        return 2 * (max(m[OUTSIDE][BEGIN], m[BEGIN][BEGIN], m[BEGIN][INSIDE], m[INSIDE][INSIDE], m[INSIDE][BEGIN], m[BEGIN][OUTSIDE], m[INSIDE][OUTSIDE]) - min(m[OUTSIDE][OUTSIDE], m[BEGIN][OUTSIDE], m[INSIDE][OUTSIDE], m[OUTSIDE][BEGIN]))

    def viterbi(self, scores: list[tuple[float, float]]) -> list[int]:
        """The best tags of a run whose neighbours are outside."""
        m, best, back = self.moves, [0.0, float("-inf"), float("-inf")], []
        for b, i in scores:
            step, best2 = [], []
            for to, own in ((OUTSIDE, 0.0), (BEGIN, b), (INSIDE, i)):
                at = max(range(3), key=lambda k: best[k] + m[k][to] if not (to == INSIDE and k == OUTSIDE) else float("-inf"))
                step.append(at)
                best2.append((best[at] + m[at][to] if not (to == INSIDE and at == OUTSIDE) else float("-inf")) + own)
            best = best2
            back.append(step)
        at = max(range(3), key=lambda k: best[k] + m[k][OUTSIDE])
        out = []
        for step in reversed(back):
            out.append(at)
            at = step[at]
        return out[::-1]


class Tagger(dict):
    """A worker's field: token -> number of its row of scores (own, for the next token, for the one before; begin and inside each). Tokens that are alike share a row."""

    MOST = 250_000

    def __init__(self, field: Field):
        self.field, self.slack = field, field.slack()
        self._empty()

    def _empty(self):
        self.clear()
        self.rows, self.table, self.like = [(0.0,) * 6], np.zeros((1, 6), np.float32), {}
        self[""] = 0

    def __missing__(self, token: str) -> int:
        low = token.lower().strip(".")
        # the shape follows from these; a long token's is shorter than its kinds
        like = (token.translate(_KINDS), _is_hex(token), _unspoken(token)) if len(token) <= 64 else tuple(shape(token))
        same = (like, low if low in self.field.words else token if len(token) == 1 else "")
        n = self.like.get(same)
        if n is None:
            f = self.field
            own, near = [f"own {x}" for x in shape(token)], beside(token, f.words)
            self.rows.append((*f.score(own), *f.score([f"before {x}" for x in near]), *f.score([f"after {x}" for x in near])))
            self.like[same] = n = len(self.rows) - 1
        self[token] = n
        return n

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The field's (start, end) in each text."""
        if len(self) > self.MOST:
            self._empty()
        cut = [TOKEN.findall(t) for t in texts]
        size = np.array([len(c) + 2 for c in cut])
        ids = np.zeros(size.sum(), np.int64)
        ends = np.cumsum(size)
        starts = ends - size + 1
        for c, a in zip(cut, starts.tolist()):
            ids[a : a + len(c)] = np.fromiter(map(self.__getitem__, c), np.int64, len(c))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.float32)])
        near = self.table[ids]
        score = near[:, 0:2].copy()
        score[1:] += near[:-1, 2:4]
        score[:-1] += near[1:, 4:6]
        files = np.array([self.field.score([f"file {x}" for x in of_file(t)]) for t in texts], np.float32).reshape(-1, 2)
        gain = score.max(axis=1) + np.repeat(files.max(axis=1), size) + self.slack
        gain[starts - 1] = gain[ends - 1] = -np.inf
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        live = np.flatnonzero(gain >= 0)
        of = np.searchsorted(ends, live, "right")
        for k in np.unique(of).tolist():
            a0, n = int(starts[k]), len(cut[k])
            own = gain[a0 : a0 + n]
            runs: list[list[int]] = []
            at = 0
            hot = (live[of == k] - a0).tolist()
            while at < len(hot):
                a = b = hot[at]
                total = float(own[a])
                while at + 1 < len(hot) and hot[at + 1] == b + 1:
                    at += 1
                    b += 1
                    total += float(own[b])
                at += 1
                # as far to either side as the run's gain can pay for
                left = total
                while a > 0 and left + own[a - 1] >= 0:
                    a -= 1
                    left += float(own[a])
                right = total
                while b + 1 < n and right + own[b + 1] >= 0:
                    b += 1
                    right += float(own[b])
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            tags: dict[int, int] = {}
            for a, b in runs:
                tags.update(zip(range(a, b + 1), self.field.viterbi([tuple(x) for x in (score[a0 + a : a0 + b + 1] + files[k]).tolist()])))
            if any(tags.values()):
                for i, m in enumerate(TOKEN.finditer(texts[k])):
                    if tags.get(i) == BEGIN or tags.get(i) == INSIDE and (not out[k] or tags.get(i - 1, 0) == OUTSIDE):
                        out[k].append(m.span())
                    elif tags.get(i) == INSIDE:
                        out[k][-1] = (out[k][-1][0], m.end())
        return out

    def all_spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of base spans and the field's others, by start and kind."""
        out = []
        for text, found in zip(texts, self.spans(texts)):
            base, ends, upto = base_spans(text), [], 0
            for _, _, y in base:
                upto = max(upto, y)
                ends.append(upto)
            starts = [x for x, _, _ in base]

            def free(a: int, b: int) -> bool:
                before = bisect_left(starts, b)  # spans that start before the end
                return not before or ends[before - 1] <= a

            out.append(sorted([*base, *((a, 3, b) for a, b in found if free(a, b))]) if found else base)
        return out


def drawn_secret(draw: random.Random, alphabet: str) -> str:
    """16 to 48 characters, short ones more often; half the time with a short name before a mark, or in two parts."""
    body = "".join(draw.choices(alphabet, k=min(draw.randint(16, 48), draw.randint(16, 48))))
    how = draw.randrange(4)
    if how == 0:
        return "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 4))) + draw.choice("-_") + body
    if how == 1:
        at = draw.randint(6, len(body) - 6)
        return body[:at] + draw.choice(".-_") + body[at:]
    return body


_DRAWN = re.compile(r"(?:[A-Za-z]{2,5}[-_])?(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{16,}=*")


def unclear(token: str) -> bool:
    """Whether a token has the looks of a secret: 16 or more letters and digits whose kinds change often, a short name before them aside."""
    if len(token) < 16 or not _DRAWN.fullmatch(token):
        return False
    kinds = token.translate(_KINDS)
    return 4 * (1 + sum(x != y for x, y in zip(kinds, kinds[1:]))) >= len(token)


def _covered(tokens: list[tuple[str, int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token meets a span; both are sorted by their starts, and spans may overlap."""
    out, at, upto = [], 0, -1
    for _, a, b in tokens:
        while at < len(spans) and spans[at][0] < b:
            upto = max(upto, spans[at][1])
            at += 1
        out.append(a < upto)
    return out


def windows(text: str, kinds: tuple[str, ...] = tuple(KINDS_OF_ORDINARY)) -> list[tuple[list[str], list[int], list[str]]]:
    """Windows of tokens with their tags and the text's features.

    Several around each of up to PER_DOC secrets, with secrets and with ordinary
    tokens of `kinds` in its place; one around the longest other token with a
    digit; and in texts without secrets two from the middle, as it is and with an
    ordinary token.  Linear in the text.
    """
    tokens = [(m[0], *m.span()) for m in TOKEN.finditer(text)]
    if not tokens:
        return []
    parts, tags, inside = _secret_parts(text), [], 0
    for _, a, b in tokens:
        while inside < len(parts) and parts[inside][1] <= a:
            inside += 1
        if inside < len(parts) and a < parts[inside][1] and parts[inside][0] < b:
            tags.append(INSIDE if tags and tags[-1] != OUTSIDE and tokens[len(tags) - 1][2] > parts[inside][0] else BEGIN)
        else:
            tags.append(OUTSIDE)
    half, file, out = WINDOW // 2, of_file(text), []
    draw = random.Random(hashlib.md5(text.encode()).digest())

    def window(names: list[str], i: int):
        a = max(0, i - half)
        return names[a : i + half + 1], tags[a : i + half + 1], file

    def clear(w) -> bool:
        return not any(tag == OUTSIDE and unclear(t) for t, tag in zip(*w[:2]))

    def with_ordinary(names: list[str], i: int):
        """The window around i with ordinary tokens in i's place, if nothing beside it is unclear."""
        own, own_tags, _ = window(names, i)
        at = min(i, half)
        if kinds and clear((own[:at] + own[at + 1 :], own_tags[:at] + own_tags[at + 1 :])):
            drawn = TOKEN.findall(ordinary(draw, kinds))[:WINDOW]
            # as many tokens as other windows have
            less = min(at, len(drawn) // 2)
            own, own_tags = own[less:at] + drawn + own[at + 1 :], own_tags[less:at] + [OUTSIDE] * len(drawn) + own_tags[at + 1 :]
            added.append((own[: WINDOW + 3], own_tags[: WINDOW + 3], file))

    names, added = [t for t, _, _ in tokens], []
    found = [i for i, t in enumerate(tags) if t == BEGIN][:PER_DOC]
    if found:
        spans = sorted((a, b) for a, _, b in base_spans(text))
        covered = _covered(tokens, spans)
        plain = [t for t, tag, c in zip(names, tags, covered) if tag == OUTSIDE and not c] or ["a"]
        hidden = [draw.choice(plain) if c and tag == OUTSIDE else t for t, tag, c in zip(names, tags, covered)]
        for i in found:
            alone = i + 1 == len(tags) or tags[i + 1] != INSIDE
            out.append(window(names, i))
            for alphabet in ALPHABETS * 2:
                if alone:
                    hidden[i] = drawn_secret(draw, alphabet)
                out.append(window(hidden, i))
            if alone:
                for _ in range(PER_SECRET):
                    with_ordinary(hidden, i)
    else:
        out.append(window(names, len(names) // 2))
        with_ordinary(names, len(names) // 2)
    other = [(-len(t), i) for i, (t, tag) in enumerate(zip(names, tags)) if tag == OUTSIDE and len(t) > 1 and any(map(str.isdigit, t))]
    if other:
        out.append(window(names, min(other)[1]))
    return [w for w in out if clear(w)] + added


def fit(examples: list[tuple[list[str], list[int], list[str]]], rounds: int = 100, rate: float = 0.15, prior: float = 1e-4) -> Field:
    """Maximum likelihood over the windows."""
    seen: dict[str, int] = {}
    for tokens, tags, _ in examples:
        for i, t in enumerate(tags):
            if t == BEGIN and i:
                low = tokens[i - 1].lower().strip(".")
                if low.isalpha():
                    seen[low] = seen.get(low, 0) + 1
    words = {w: n for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:NEIGHBOURS]}
    names: dict[str, int] = {}
    n, most = len(examples), max((len(t) for t, _, _ in examples), default=0)
    if not any(any(tags) for _, tags, _ in examples):
        return Field({}, [[0.0, -50.0, -50.0], [0.0, -50.0, -50.0], [0.0, -50.0, -50.0]], {})
    # places with the same features count as one, with their number: words share few shapes
    numbers: dict[tuple[str, ...], int] = {}
    which = np.array([numbers.setdefault((*(f"own {s}" for s in shape(tokens[i])), *(f"before {s}" for s in (beside(tokens[i - 1], words) if i else [])), *(f"after {s}" for s in (beside(tokens[i + 1], words) if i + 1 < len(tokens) else [])), *(f"file {s}" for s in file)), len(numbers)) for tokens, _, file in examples for i in range(len(tokens))])
    rows = [[names.setdefault(x, len(names) + 1) for x in row] for row in numbers]
    wide = max(map(len, rows))
    flat = np.array([r + [0] * (wide - len(r)) for r in rows])
    size = np.array([len(t) for t, _, _ in examples])
    ends = np.cumsum(size)
    where = np.full((n, most), -1)
    for k in range(n):
        where[k, : size[k]] = np.arange(ends[k] - size[k], ends[k])
    there = where >= 0
    gold = np.zeros((n, most), int)
    for k, (_, tags, _) in enumerate(examples):
        gold[k, : len(tags)] = tags
    one = np.eye(3)
    gold1 = one[gold] * there[..., None]
    pairs = np.einsum("nti,ntj->ij", gold1[:, :-1], gold1[:, 1:])
    weights, moves = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = -1e4
    m1, m2, q1, q2 = (np.zeros_like(x) for x in (weights, weights, moves, moves))

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, rounds + 1):
        own = weights[flat].sum(axis=1)[which]
        e = np.where(there[..., None], own[where], 0.0)
        e[:, 0, INSIDE] += -1e4
        t = moves + barred
        alpha, beta = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        alpha[:, 0] = e[:, 0]
        for i in range(1, most):
            alpha[:, i] = np.where(there[:, i, None], lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(most - 2, -1, -1):
            beta[:, i] = np.where(there[:, i + 1, None], lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        miss = (gold1 - p)[there]
        miss = np.stack([np.bincount(which, miss[:, k], len(rows)) for k in range(3)], 1)
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(miss[:, k], wide), len(weights)) for k in range(3)], 1) / n - prior * weights
        grad[0] = grad[:, OUTSIDE] = 0
        up = (pairs - joint.sum(axis=(0, 1))) / n - prior * moves
        for x, g, a, b in ((weights, grad, m1, m2), (moves, up, q1, q2)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Field({x: (float(weights[i, BEGIN]), float(weights[i, INSIDE])) for x, i in names.items()}, (moves + 0).tolist(), words)


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """The field, fitted on the windows of at most `sample` different texts of `docs`; at most WINDOWS windows reach the driver."""
    ship(docs.sparkSession)
    texts = docs.select(F.lit(0).alias("all"), F.col(text).alias("text")).where("text IS NOT NULL")
    share = F.lit(min(1.0, 2 * sample / max(1, texts.count())))
    drawn = distinct_sample(texts, "all", "text", share, sample, "secrets-drawn").select("text")

    def cut(batches):
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                # a text without secrets is an example one time in eight
                if base_spans(t) or hashlib.md5(t.encode()).digest()[0] < 32:
                    rows += windows(t)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["tokens", "tags", "file"])

    rows = drawn.mapInArrow(cut, "tokens array<string>, tags array<int>, file array<string>")
    got = rows.orderBy(F.xxhash64("tokens"), "tokens").limit(WINDOWS).toArrow().to_pylist()
    return fit(sorted({(tuple(r["tokens"]), tuple(r["tags"]), tuple(r["file"])) for r in got}))


_taggers: dict[bytes, Tagger] = {}


def _tagger(key: bytes, field: Field) -> Tagger:
    sole_cache("taggers", _taggers.clear)
    if key not in _taggers:
        _taggers.clear()
        _taggers[key] = Tagger(field)
    return _taggers[key]


def _scanned(docs: DataFrame, field: Field, text: str, make, schema: str | object) -> DataFrame:
    """`make(batch, texts, spans)` over slices of `docs`."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text)
    key = hashlib.md5(repr(field).encode()).digest()

    def scan(batches):
        tagger = _tagger(key, shared.value)
        for b in batches:
            trim()
            texts = [t or "" for t in b.column(at).to_pylist()]
            part = np.cumsum([len(t) for t in texts]) // (2 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if texts else [0]
            for x, y in zip(cuts, cuts[1:]):
                yield make(b.slice(x, y - x), texts[x:y], tagger.all_spans(texts[x:y]))

    return docs.mapInArrow(scan, schema)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""

    def rows(b, texts, found):
        counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
        base = [hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        return pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base), pa.array([_joined(s) for s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scanned(docs, field, "text", rows, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redacted(text: str, spans) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """`docs` with every span replaced by a mark, n_chars counted anew where it was changed; null texts stay null."""
    field = field or learn(docs)
    columns, schema = docs.columns, docs.schema

    def rows(b, texts, found):
        at = columns.index("text")
        nulls = b.column(at).is_null().to_pylist()
        out = [None if n else redacted(t, s) for t, s, n in zip(texts, found, nulls)]
        arrays = list(b.columns)
        arrays[at] = pa.array(out, arrays[at].type)
        if "n_chars" in columns:
            k = columns.index("n_chars")
            arrays[k] = pa.array([len(o) if s else n for o, s, n in zip(out, found, b.column(k).to_pylist())], arrays[k].type)
        return pa.RecordBatch.from_arrays(arrays, columns)

    return _scanned(docs, field, "text", rows, schema)


def secret_scan(docs: DataFrame) -> DataFrame:
    return find(docs, learn(docs))
