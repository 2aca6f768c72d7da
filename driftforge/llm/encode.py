"""Whole texts to ids with a public tokenizer whose pre-tokens never cross white space: words are encoded once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: ASCII signs but the apostrophe, which may begin a pre-token of its own.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters up to here have one lower-case letter each (U+0130 aside) and no decomposed forms to join.
_LATIN = "\u024f"


def _byte_letters() -> dict[int, int]:
    """Latin-1 code of a byte -> its character in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}


def _pieces(cells: pa.Array, at: np.ndarray | slice = slice(None)) -> list[bytes]:
    """The bytes of an unsliced large string or binary array: of each cell, or joined from each place in `at` to the next."""
    _, offsets, data = cells.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(cells) + 1)[at].tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Merges:
    """Byte pair encoding of many words at once: in each round the words of one length merge their best pair, the first of equals."""

    #: Rank of a pair that is not merged; bytes of the longest word taken.
    none, most = np.int32(2**31 - 1), 48

    def __init__(self, model: dict, letters: dict[int, int]) -> None:
        """model: a tokenizer's, as in its file. ValueError: it is not a plain byte-level one with marked word ends."""
        end = model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not end or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("not byte pairs with marked ends")
        ids, signs = model["vocab"], [chr(letters.get(b, b)) for b in range(256)]
        if not all(x in ids and x + end in ids for x in signs):
            raise ValueError("bytes without an id")
        self.inner, self.last = (np.array([ids[x + e] for x in signs], np.uint16) for e in ("", end))
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a pair with two ranks")
        self.rank = np.argsort(keys).astype(np.int32)
        self.keys, self.made = keys[self.rank], np.array([ids[a + b] for a, b in pairs], np.uint16)
        self.begin = [self._ranks(self.inner[:, None], x[None, :]) for x in (self.inner, self.last)]  # by the bytes of a pair

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Of each word (1 to `most` bytes, one pre-token): its ids, 16-bit."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        begin, data = np.cumsum(n) - n, np.frombuffer(b"".join(words), np.uint8)
        by_length = np.argsort(n, kind="stable")
        upto = np.searchsorted(n[by_length], np.arange(self.most + 2))
        out = [b""] * len(words)
        of, ids, ranks = np.empty(0, np.int64), None, None
        for m in range(int(n.max(initial=0)), 0, -1):
            new = by_length[upto[m] : upto[m + 1]]
            raw = data[begin[new][:, None] + np.arange(m)]
            pairs = self.begin[0][raw[:, :-1], raw[:, 1:]]
            if m > 1:
                pairs[:, -1] = self.begin[1][raw[:, -2], raw[:, -1]]
            raw = np.concatenate((self.inner[raw[:, :-1]], self.last[raw[:, -1:]]), 1)
            of, ids, ranks = np.concatenate((of, new)), raw if ids is None else np.concatenate((ids, raw)), pairs if ranks is None else np.concatenate((ranks, pairs))
            at = ranks.argmin(1) if m > 1 else np.zeros(len(of), np.int64)
            best = ranks[np.arange(len(of)), at] if m > 1 else np.full(len(of), self.none)
            over = best == self.none
            done = ids[over].astype("<u2").tobytes()
            for k, w in enumerate(of[over].tolist()):
                out[w] = done[2 * m * k : 2 * m * (k + 1)]
            if m == 1:
                break
            # the pair's first place gets the merged id, what stood behind the second moves up
            of, at, best = of[~over], at[~over], best[~over]
            k, column = np.arange(len(of)), np.arange(m - 1)
            moved = column + (column > at[:, None])
            ids = np.take_along_axis(ids[~over], moved, 1)
            ids[k, at] = self.made[best]
            ranks = np.take_along_axis(ranks[~over], moved[:, : m - 2], 1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < m - 2)
            ranks[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self._ranks(ids[after, at[after]], ids[after, at[after] + 1])
        return out


class Encoder(dict):
    """Word -> its ids as little-endian 16-bit integers, remembered for two generations of `bound` words.

    The tokenizer drops white space and never joins pre-tokens across it, so the ids of a text are those of its
    words. It lower-cases, and it parts a letter or digit from the signs after it. A word of Latin letters alone is one
    pre-token and goes straight to the model; all others go the whole way. Special tokens hold no white space; words
    with `<|` are encoded as they are. Of many texts at once (all_ids) the new words of letters are merged together.
    """

    bound = 600_000
    #: Bytes of the texts whose words are told apart together.
    together = 8 << 20

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path or default_path())
        if self.tool.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model, self.letters, self.old = self.tool.model, _byte_letters(), {}

    @cached_property
    def merges(self) -> Merges | None:
        """None: of another kind of tokenizer; every word goes to the model alone."""
        try:
            return Merges(json.loads(self.tool.to_str())["model"], self.letters)
        except ValueError:
            return None

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self._make(word)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _make(self, word: bytes) -> bytes:
        if b"<|" not in word:
            low = word.lower()
            core = low.rstrip(_SIGNS)
            if core.isalpha() and len(core) == len(low):  # ASCII letters alone
                return self._whole(core.decode())
            text = core.decode()
            if text and len(core) < len(low):
                last = text[-1].lower()[-1]  # lower case may end in a mark
                if last.isalpha() or last in "0123456789":
                    return self[core] + self[low[len(core) :]]
            elif text.isalpha() and max(text) <= _LATIN and "\u0130" not in text:
                return self._whole(text.lower().encode().decode("latin-1").translate(self.letters))
        return np.array(self.tool.encode(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def _whole(self, letters: str) -> bytes:
        return b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(letters)])

    def ids(self, text: bytes) -> bytes:
        if b"<|" not in text:  # fewer different words
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))

    def all_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """ids() of each text; different words of many texts are told apart first and looked up once."""
        step = np.cumsum([len(x) for x in texts]) // self.together
        ends = [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield from self._ids_of([x if b"<|" in x else x.lower() for x in texts[a:b]])

    def _ids_of(self, texts: list[bytes]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        names = _pieces(words.dictionary)
        each = list(map(self.get, names))
        if self.merges:
            self._learn([w for w, x in zip(names, each, strict=True) if x is None])
        each = [self[w] if x is None else x for w, x in zip(names, each, strict=True)]
        stops = np.cumsum(pc.list_value_length(lists).to_numpy())
        return _pieces(pa.array(each, pa.large_binary()).take(words.indices), np.concatenate(([0], stops)))


    def _learn(self, words: list[bytes]) -> None:
        """Remembers those of the new words that are Latin letters, with or without signs after them, all at once."""
        new: dict[bytes, bytes] = {}  # letters -> in lower case
        got: dict[bytes, bytes] = {}
        parted, cores = [], []
        for word in words:
            if self.old and (ids := self.old.pop(word, None)) is not None:
                got[word] = ids
                continue
            core = word
            if not word.isalpha():
                if b"<|" in word:
                    continue
                core = word.rstrip(_SIGNS)
            if core.isalpha():
                low = core.lower()
            elif core.isascii() or not (text := core.decode()).isalpha() or max(text) > _LATIN or "\u0130" in text:
                continue
            else:
                low = text.lower().encode()
            if len(low) > self.merges.most:
                continue
            if len(core) < len(word):
                parted.append(word)
                cores.append(core)
                if core in self:
                    continue
            new[core] = low
        got.update(zip(new, self.merges.ids(list(new.values())), strict=True))
        for word, core in zip(parted, cores, strict=True):
            got[word] = (got.get(core) or self[core]) + self[word[len(core) :]]
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self.update(got)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)
