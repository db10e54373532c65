"""Language ID with n-gram filters that answer for all languages at once.

Learning.  From a bounded sample of labelled texts (at most `SAMPLE` different ones
per language, those of least hash) the commonest byte n-grams of each language are
counted; the `GRAMS` that most documents of a language hold go into a
bit-sliced Bloom filter: a slot holds a bit mask of languages, an n-gram sets
its language's bit in `HASHES` slots, and the AND of an n-gram's slots is the
mask of all languages that may hold it.  Languages beyond 64 take further words.

Deciding.  The masks of all n-grams of a text are popcounted per language.  A
filter of fill f answers yes to a share p = f ** HASHES of n-grams it doesn't
hold, so a count c out of n becomes (c - n p) / (1 - p).  The largest corrected
count wins, ties by the name of the language; the score is its share of the
corrected counts of the best two.

Short texts.  A text with letters of which no n-gram is in any filter (a word of
two letters has none) is judged by its `SHORT`-byte n-grams, which every text with
a letter has: the largest sum of the shares of a language's sampled documents that
hold them wins, scored as above.  Where none of those is known either it is the
language with most labelled documents, with score 0.

Rules for odd rows: only a text that is null or has no letter is `und`, with
score 0; without labelled rows all are `und`; repeated rows and null ids are judged each by its text; an empty table
gives no rows.  Only the text decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docgauge.llm.common import distinct_sample, free_names, ship, sole_cache, trim, written

N, GRAMS, SAMPLE, HASHES, SLOTS = 5, 20_000, 3000, 3, 1 << 20
SHORT, SHORT_GRAMS = 3, 5000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def normalised(text: str) -> bytes:
    """Letters in lower case, everything else one space, in UTF-8; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def grams(raw: np.ndarray, n: int = N) -> np.ndarray:
    """The n bytes from each place on, as one number; n is at most 8."""
    m = max(0, len(raw) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | raw[k : k + m].astype(np.uint64)
    return out


def _slots(g: np.ndarray, k: int) -> np.ndarray:
    x = g * np.uint64(_MULTIPLIERS[k])
    return ((x ^ (x >> np.uint64(29))) * np.uint64(_MULTIPLIERS[(k + 1) % 3]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


@dataclass
class ShortGrams:
    """Rows of an n-gram, a language (its index) and the share of documents that hold it, by n-gram; and the commonest language."""

    grams: np.ndarray
    languages: np.ndarray
    shares: np.ndarray
    usual: int = 0

    def sums(self, text: bytes, n: int) -> np.ndarray:
        """The sum of shares for each of n languages."""
        g = np.unique(grams(np.frombuffer(text, np.uint8), SHORT))
        ranges = zip(np.searchsorted(self.grams, g, "left").tolist(), np.searchsorted(self.grams, g, "right").tolist())
        out = np.zeros(n)
        for a, b in ranges:
            out[self.languages[a:b]] += self.shares[a:b]
        return out


@dataclass
class Filters:
    """The bit-sliced filter: `words[w][slot]` has the bits of languages 64 w .. 64 w + 63."""

    languages: list[str]
    words: list[np.ndarray]
    fill: np.ndarray
    short: ShortGrams = field(default_factory=lambda: ShortGrams(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)))

    @classmethod
    def of(cls, held: dict[str, np.ndarray]) -> Filters:
        languages = sorted(held)
        words = []
        for w in range(0, max(1, len(languages)), 64):
            some = languages[w : w + 64]
            bits = np.zeros(SLOTS, np.uint8 if len(some) <= 8 else np.uint64)
            for i, lang in enumerate(some):
                for k in range(HASHES):
                    np.bitwise_or.at(bits, _slots(held[lang], k), bits.dtype.type(1 << i))
            words.append(bits)
        fill = np.array([np.count_nonzero(words[i // 64] >> words[i // 64].dtype.type(i % 64) & words[i // 64].dtype.type(1)) / SLOTS for i in range(len(languages))])
        return cls(languages, words, fill)

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the languages that may hold it."""
        at = [_slots(g, k) for k in range(HASHES)]
        return [np.bitwise_and.reduce([bits[a] for a in at]) for bits in self.words]

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Corrected counts, a row per text raw[start:end]; n-grams don't reach across texts."""
        masks = self.masks(grams(raw))
        last = np.maximum(starts, ends - N + 1)
        n = (last - starts).astype(float)
        out = np.zeros((len(starts), len(self.languages)))
        for i in range(len(self.languages)):
            bits = masks[i // 64]
            hit = (bits >> bits.dtype.type(i % 64) & bits.dtype.type(1)).astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(hit)])
            out[:, i] = upto[np.minimum(last, len(hit))] - upto[np.minimum(starts, len(hit))]
        p = self.fill**HASHES
        return np.maximum(0, (out - n[:, None] * p) / (1 - p))


def counted(texts: DataFrame) -> DataFrame:
    """size, lang, gram, n: how many texts of a language hold each n-gram of N and of SHORT bytes."""

    def count(batches):
        sole_cache("language", lambda: None)
        for b in batches:
            seen: dict[str, list[bytes]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, []).append(normalised(text))
            for lang, found in seen.items():
                for size in (N, SHORT):
                    g, n = np.unique(np.concatenate([np.unique(grams(np.frombuffer(x, np.uint8), size)) for x in found]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), size, np.int32)), pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["size", "lang", "gram", "n"])

    return texts.mapInArrow(count, "size int, lang string, gram long, n long").groupBy("size", "lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, sample: int = SAMPLE, top: int = GRAMS) -> Filters:
    """`labelled` has text and lang. At most `sample` texts and `top` n-grams a language are looked at; the latter reach the driver."""
    ship(labelled.sparkSession)
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters.of({})
    # twice the share that is needed where texts differ
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 2 * sample / n))]), F.col("by"))
    texts = written(distinct_sample(labelled, "lang", "text", share, sample, "language-drawn").select("text", "lang"), "language-sample")
    drawn = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.row_number().over(Window.partitionBy("size", "lang").orderBy(F.desc("n"), "gram"))
    best = counted(texts).withColumn("at", at).where(F.col("at") <= F.when(F.col("size") == N, top).otherwise(SHORT_GRAMS)).drop("at")
    rows = best.where(F.col("n") > 0).toArrow().sort_by([("gram", "ascending"), ("lang", "ascending")])
    size, lang, gram, n = (rows.column(k).to_numpy() for k in range(4))
    gram = gram.view(np.uint64)
    filters = Filters.of({x: gram[(size == N) & (lang == x)] for x in sizes})
    index = {x: i for i, x in enumerate(filters.languages)}
    few = np.flatnonzero(size == SHORT)
    few = few[np.lexsort(([index[x] for x in lang[few]], gram[few]))]
    shares = n[few] / np.array([drawn[x] for x in lang[few]], float)
    usual = index[min(sizes, key=lambda x: (-sizes[x], x))]
    filters.short = ShortGrams(gram[few], np.array([index[x] for x in lang[few]], np.int64), shares, usual)
    return filters


def predict(docs: DataFrame, filters: Filters, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the columns `lang` and `score`, under other names where those are in use; they are the last two."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS bytes for up to 8 languages
    lang, score = free_names(docs, lang, score)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    columns = docs.columns

    def judged(batches):
        sole_cache("language", lambda: None)
        f = shared.value
        for b in batches:
            trim()
            size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // (4 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for x, y in zip(cuts, cuts[1:]):
                rows = b.slice(x, y - x)
                texts = [normalised(t) if t else b"" for t in rows.column(at).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                starts = ends - [len(t) for t in texts]
                counts = f.counts(np.frombuffer(b"".join(texts), np.uint8), starts, ends) if f.languages else np.zeros((len(texts), 1))
                fixed = np.zeros(len(texts), bool)
                for i in np.flatnonzero(counts.max(axis=1) <= 0).tolist() if f.languages else ():
                    if texts[i] and any(map(str.isalpha, texts[i].decode())):
                        counts[i] = f.short.sums(texts[i], len(f.languages))
                        fixed[i] = not counts[i].any()
                best = counts.argmax(axis=1)
                first = counts.max(axis=1)
                second = np.sort(counts, axis=1)[:, -2] if counts.shape[1] > 1 else np.zeros(len(texts))
                known = first > 0
                best[fixed] = f.short.usual
                names = [f.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), (known | fixed).tolist())]
                scores = np.where(known, first / np.where(known, first + second, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, lang, score])

    return docs.mapInArrow(judged, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, **how) -> Filters:
    return learn(docs.where(~held_out(F.col("doc_id"))), **how)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    filters = learned(docs)
    found = predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents with a language; `und` ones, without a letter, go. Columns as in `docs`."""
    found = predict(docs, learned(docs))
    return found.where(F.col(found.columns[-2]) != UNKNOWN).select(*docs.columns)
