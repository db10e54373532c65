"""Fast, exact whole-text encoding with a public tokenizer file.

Both public vocabularies cut a text into pre-tokens that never reach across a
white-space boundary: a pre-token starts at the beginning of every white-space
run that follows other characters (`TokenCache.lead` true: the run belongs to
the next word), or white space is dropped altogether (`lead` false).  A text is
therefore cut there, each *distinct* chunk is encoded once by the library, and
texts are put together from the chunks' ids.  Results equal
``Tokenizer.encode(text, add_special_tokens=False).ids`` for every text;
``tests/llm`` holds this against the library on random Unicode.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docgauge.llm.common import sole_cache

#: The characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands between chunks while Arrow cuts a batch; texts that hold it take the other path.
MARK = "\ue000"
_IRREGULAR = "[\t\x0b\x0c\r\u0085\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ue000]|[ \n][ \n]"
_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_SIMPLE = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:]*)")


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCache:
    """Encodes batches of texts; one per Python worker and vocabulary.

    `most` bounds the chunks that are remembered, so memory doesn't grow with
    the corpus; beyond it the memory is emptied and filled again.
    """

    def __init__(self, path: str, most: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lead = bool(self.tok.encode("a b", add_special_tokens=False).ids != self.tok.encode("a  b", add_special_tokens=False).ids)
        self.most = most
        #: The narrowest type that holds the ids.
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # whether a token starts (ends) a word, by id: what is before (after) it then belongs to another word
        vocabulary = self.tok.get_vocab()
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self._edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.lead else t.endswith("</w>"))]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.empty(0, "<u4")

    def _add(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        a = len(self.first)
        self.known.update(zip(chunks, range(a, a + len(chunks))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _words(self, words: list[str]) -> list[str]:
        """One call for many plain words, told apart by the tokens at their edges; gives back those that can't be told apart."""
        back = []
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            ids = np.asarray(self.tok.encode_batch_fast([("" if self.lead else "\n").join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self._edge[ids])
            if len(edges) == len(part):
                self._add(part, np.diff(edges, append=len(ids)) if self.lead else np.diff(edges, prepend=-1), ids)
            else:
                back += part
        return back

    def _others(self, chunks: list[str]) -> None:
        if chunks:
            got = [x.ids for x in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
            self._add(chunks, np.fromiter(map(len, got), np.int64, len(got)), np.fromiter((i for x in got for i in x), "<u4"))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(int(upto[-1]), len(self.flat)) < 1 << 31 else np.int64
        at = np.arange(upto[-1], dtype=kind)
        at += np.repeat((self.first[which] - upto[:-1]).astype(kind), n)
        return self.flat[at], upto

    def _learn(self, chunks: list[str]) -> None:
        """A plain word with punctuation behind it has the ids of both, one after the other."""
        known, split, plain, rest = self.known, [], {}, {}
        for c in chunks:
            if c.isalpha() and c.isascii() and not self.lead:
                plain[c] = None
            elif (m := _SIMPLE.fullmatch(c)) and (c[0] == " ") == self.lead:
                a, b = m.groups()
                a = a if self.lead else a.lower()
                plain[a] = None
                if b:
                    split.append((c, a, b))
                    rest[b] = None
                elif a != c:
                    split.append((c, a, ""))
            else:
                rest[c] = None
        back = self._words([c for c in plain if c not in known])
        self._others([*back, *(c for c in rest if c not in known)])
        if split:
            ids, upto = self._gather(np.fromiter((known[x] for _, a, b in split for x in (a, b)), np.int64, 2 * len(split)))
            self._add([c for c, _, _ in split], np.diff(upto[::2]), ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i+1]]. Null counts as empty."""
        # a slice keeps its parent's offsets, which pc.ascii_lower would read against a new buffer: copy it first
        texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        n, rows = len(texts), {}
        if self.lead:
            odd = odd | pc.match_substring_regex(texts, "^[ \n]|[ \n]$").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            rows[i] = _WORD.findall(texts[i].as_py())
        # each step's text goes before the next one's is made
        if self.lead:
            texts = pc.replace_substring(texts, " ", MARK + " ")
            texts = pc.replace_substring(texts, "\n", MARK + "\n")
        else:
            # white space and the case of A-Z make no difference here
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
            texts = pc.replace_substring(texts, " ", MARK)
        chunks = pc.split_pattern(texts, MARK)
        del texts
        bounds = chunks.offsets.to_numpy()
        coded = pc.dictionary_encode(chunks.values)
        del chunks
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        del coded
        known, unknown = self.known, -1
        codes = np.fromiter(map(known.get, words, repeat(unknown)), np.int32, len(words))
        new = np.flatnonzero(codes == unknown)
        need = [words[i] for i in new.tolist()]
        more = [w for w in set().union(*rows.values()) if w not in known] if rows else []
        if len(known) + len(need) + len(more) > self.most:
            self._forget()
            known, new, need, more = self.known, np.arange(len(words)), words, set().union(*rows.values())
        self._learn([w for w in dict.fromkeys([*need, *more]) if w])
        codes[new] = np.fromiter(map(known.__getitem__, need), np.int32, len(need))
        which = codes[which]
        del words, need
        ids, upto = self._gather(which)
        offsets = upto[bounds - bounds[0]]
        if rows:
            out = [self._gather(np.fromiter((known[w] for w in rows[i]), np.int64, len(rows[i])))[0] if i in rows else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
            offsets, ids = np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.concatenate(out)
        return ids, offsets

    def encode_in_parts(self, texts: pa.Array, most_bytes: int = 8 << 20):
        """(first row, ids, offsets) of slices of about `most_bytes` each."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield a, *self.encode(texts.slice(a, b - a))


def gathered(batches, column: int, least_bytes: int = 24 << 20):
    """Batches joined until their texts have `least_bytes`: the more texts at once, the fewer different words a text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least_bytes:
            joined = held[0] if len(held) == 1 else pa.concat_batches(held)
            del b
            held, size = [], 0  # the parts go before the whole is worked on
            yield joined
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


_caches: dict[str, TokenCache] = {}


def cache_for(path: str) -> TokenCache:
    sole_cache(path, lambda: _caches.pop(path, None))
    if path not in _caches:
        _caches[path] = TokenCache(path)
    return _caches[path]
