"""Fill-in-middle: a text is cut at two units, and its parts change places behind sentinels.

Units.  `chars` are code points; `words` and `lines` cover the whole text too:
runs of white space and runs of other characters, and stretches up to and with a
line feed.  What makes a unit end is an ASCII character that changes the class
(white space for words, the line feed for lines, none for code points, which are
one class).  One Aho-Corasick automaton finds these characters and the sentinels
in one scan.  Between two events lie only characters of one class, so what a gap
adds to the count of units is plain arithmetic (its length for code points, one
for a word), and the place of unit k follows from the sparse events alone: a
binary search for the last event before it, and the rest within the gap.

Choice.  h1 to h4 are the first four groups of eight digits of the hexadecimal
SHA-256 of `seed:doc_id`.  Prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, middle after the larger.  Texts that are empty or hold a
sentinel stay plain, as do those with h3 % 100 >= `rate`; of the others those
with h4 % 100 < `spm_rate` give suffix first (spm), the rest prefix first (psm).

Each row is worked on alone, in Arrow batches; nothing is shuffled.

Rules for odd rows: a null text counts as empty and is plain; a null doc_id is
hashed as no digits; repeated rows give equal rows; very long texts are cut like
others; an empty table gives no rows; other columns are left unread, so names
may clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import arrow_schema, ship

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
WHITE = "\t\n\x0b\x0c\r "
#: The characters that change the class, by unit.
CHANGES = {"chars": "", "words": WHITE, "lines": "\n"}
RATE, SPM_RATE, SEED = 90, 20, 1


@dataclass
class Events:
    """Where units begin, told by sparse events: unit `first[e]` begins at `at[e]`, and those behind it up to the next event one character each (`step` 1) or never (0)."""

    at: np.ndarray
    first: np.ndarray
    units: int
    length: int
    step: int
    sentinel: bool

    def place(self, unit: int) -> int:
        """Where unit number `unit` begins; the text's length for the number of all units."""
        if unit >= self.units:
            return self.length
        e = int(np.searchsorted(self.first, unit, "right")) - 1
        return int(self.at[e]) + self.step * (unit - int(self.first[e]))


class Scanner:
    """The automaton of one unit and its sentinels; not for pickling, a worker makes its own."""

    def __init__(self, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS):
        import ahocorasick

        for a in sentinels:
            for b in sentinels:
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError("sentinels must not be empty nor overlap one another or themselves")
        if len(set(sentinels)) < 3:
            raise ValueError("sentinels must differ")
        self.unit, self.sentinels = unit, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in CHANGES[unit]:
            self.automaton.add_word(c, 0)
        # a sentinel's number, 1 to 3, after those of class changes; a sentinel may be one of these characters itself
        for k, s in enumerate(sentinels, 1):
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        self.marks = {s for s in sentinels if s in CHANGES[unit]}

    def events(self, text: str) -> Events:
        found = list(self.automaton.iter(text))
        sentinel = any(k for _, k in found)
        n = len(text)
        if self.unit == "chars":
            # each gap and each event's characters are code points: the gaps' lengths add up
            ends = np.fromiter((e + 1 for e, _ in found), np.int64, len(found))
            at = np.concatenate([[0], ends[ends < n]]) if n else np.empty(0, np.int64)
            return Events(at, at, n, n, 1, sentinel)
        change = np.fromiter((e for e, k in found if not k or text[e] in self.marks), np.int64)
        if self.unit == "lines":
            at = np.concatenate([[0], change[change < n - 1] + 1]) if n else np.empty(0, np.int64)
        else:
            # a run of white space begins where the character before is none, a word where a gap follows
            white = change[np.diff(change, prepend=-2) > 1]
            after = change + 1
            words = after[np.diff(change, append=n) > 1]
            at = np.sort(np.concatenate([white, words, [0] if n and (not len(change) or change[0]) else []])).astype(np.int64)
        return Events(at, np.arange(len(at)), len(at), n, 0, sentinel)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


@dataclass
class Infilled:
    n: int
    form: str
    prefix: str | None
    middle: str | None
    suffix: str | None
    #: Units of prefix and middle.
    cut: tuple[int, int] | None
    output: str = field(repr=False)


def infill(text: str, doc_id: int | None, scanner: Scanner, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> Infilled:
    events = scanner.events(text)
    n, (h1, h2, h3, h4) = events.units, draws(doc_id, seed)
    if not text or events.sentinel or h3 % 100 >= rate:
        return Infilled(n, "plain", None, None, None, None, text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = events.place(first), events.place(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = scanner.sentinels
    form = "spm" if h4 % 100 < spm_rate else "psm"
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return Infilled(n, form, prefix, middle, suffix, (first, last - first), output)


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that `infill` made `output` of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (s, p) if form == "spm" else (p, s)
    if not output.startswith(one):
        raise ValueError(f"output doesn't begin with {one}")
    a, rest = output[len(one) :].split(two, 1)
    b, middle = rest.split(m, 1)
    return b + middle + a if form == "spm" else a + middle + b


def _rows(docs: DataFrame, schema: str, make, unit: str, sentinels, rate: int, spm_rate: int, seed: int) -> DataFrame:
    """`make(doc_id, infilled)` of each document, a list of rows as Arrow arrays in the order of `schema`."""
    ship(docs.sparkSession)
    wanted = arrow_schema(schema)

    def batches_of(batches):
        scanner = Scanner(unit, sentinels)
        for b in batches:
            rows = [make(d, infill(t.as_py() or "", d, scanner, rate, spm_rate, seed)) for d, t in zip(b.column(0).to_pylist(), b.column(1))]
            columns = zip(*rows) if rows else [[] for _ in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, wanted)], schema=wanted)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches_of, schema)


def fill_in_middle(docs: DataFrame, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain), output."""
    make = lambda d, x: (d, x.n, x.form, x.prefix, x.middle, x.suffix, x.output)
    return _rows(docs, "doc_id long, n long, form string, prefix string, middle string, suffix string, output string", make, unit, sentinels, rate, spm_rate, seed)


def infilling_digests(docs: DataFrame) -> DataFrame:
    """Code points as units, production sentinels: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (from output and form alone)."""

    def make(d, x):
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        back = restored(x.output, x.form)
        return d, x.n, x.form, *(x.cut or (None, None)), sha(x.output), sha(back)

    return _rows(docs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", make, "chars", SENTINELS, RATE, SPM_RATE, SEED)


SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS c4 FROM hashed),
formed AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
