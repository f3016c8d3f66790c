"""Token ids of whole texts by a public vocabulary, through the ``tokenizers`` library.

Both vocabularies split a text before they merge. Where that split is certain from ASCII classes
and Latin letters it is done here on whole batches of bytes, so that each distinct piece goes to
the library's merges once and a bounded cache keeps the result; any other chunk, or text with
white space outside ASCII or with the string of a special token, goes to the library as it is. The
ids are those that the library gives for the whole text, by default with special tokens of its own.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

#: White space other than the six ASCII characters at which chunks end.
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LETTER, DIGIT, SIGN, SPACE, END, ODD = range(6)
#: Ends each text in a batch; never part of UTF-8.
MARK = 0xFF


def classes() -> np.ndarray:
    """A class for each byte. Bytes of U+00C0 to U+00FF are letters; apostrophes start contractions."""
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[0x27] = ODD
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0x80:0xC0] = LETTER
    kind[0xC3] = LETTER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[MARK] = END
    return kind


KIND = classes()
#: Chunks that only the library may split.
ODD_CHUNK = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f']|[\xc0-\xc2\xc4-\xfe]|\xc3[\x97\xb7]")


def runs(buf: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cuts marked texts into pieces: where each starts among the bytes kept, and those bytes.

    spaced: white space is kept, the last space before a word with the word; else it is dropped,
    digits stand alone and Latin letters are lower-cased.
    """
    kind = KIND[buf]
    odd = kind == ODD
    times = np.flatnonzero(buf == 0xC3)
    times = times[(buf[times + 1] == 0x97) | (buf[times + 1] == 0xB7)]
    odd[times] = True
    space, end = kind == SPACE, kind == END
    word = ~(space | end)
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    first = word & ~before  # of each run without white space
    chunk = first | end
    if spaced:
        after = np.zeros(len(buf), bool)
        after[:-1] = word[1:]
        joined = space & after  # the last of a run of white space
        inner = np.zeros(len(buf), bool)
        inner[1:] = space[:-1]
        chunk |= joined | (space & ~inner)
        glued = np.zeros(len(buf), bool)
        glued[1:] = (joined & (buf == 0x20))[:-1]
        chunk &= ~glued
    starts = np.flatnonzero(chunk)
    if spaced:
        stray = np.maximum.reduceat(odd, starts)
        wild = np.repeat(stray, np.diff(starts, append=len(buf)))
    else:
        if not chunk[0]:
            starts = np.concatenate(([0], starts))
        wild = np.repeat(np.maximum.reduceat(odd, starts), np.diff(starts, append=len(buf)))
    turn = np.zeros(len(buf), bool)
    turn[1:] = kind[1:] != kind[:-1]
    if not spaced:
        turn |= kind == DIGIT
    cut = chunk | (turn & word & before & ~wild)
    if spaced:
        return np.flatnonzero(cut), buf
    buf = buf.copy()
    upper = ~wild & (buf >= 0x41) & (buf <= 0x5A)
    upper[1:] |= ~wild[1:] & (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    buf[upper] += 0x20
    keep = ~space
    return np.flatnonzero(cut[keep]), buf[keep]


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A vocabulary with a normalizer lower-cases and drops white space; one without keeps it.
    pieces: how many pieces the cache may hold before it starts anew; those of the cache before are
    taken over as they are met, and the rest go the next time. plain: the strings of special
    tokens in a text are ordinary text; else, as in the library, they become those tokens.
    """

    def __init__(self, path: str, pieces: int = 300_000, plain: bool = False):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.spaced = about["normalizer"] is None
        added = [] if plain else [t["content"] for t in about["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)), re.I)
        #: How they start, where that has no letters: texts without it are not searched.
        self.marks = {"" if any(c.isalpha() for c in t[:2]) else t[:2] for t in added}
        self.bare = Tokenizer(self.whole.model)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the library shows its alphabet: the signs for U+0000 to U+00FF give those of all bytes but a few that no text has
        self.alphabet = {}
        for c in map(chr, range(0x800)):
            for b, sign in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                self.alphabet[b] = sign
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.most = pieces

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Of each text the ids, then end_id."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        alone = {i: packed(self.whole.encode(t, add_special_tokens=False).ids) + packed([end_id]) for i, t in enumerate(texts) if self.goes_whole(t)}
        mark = bytes([MARK])
        buf = np.frombuffer(mark.join(b"" if i in alone else x for i, x in enumerate(raw)) + mark, np.uint8)
        starts, kept = runs(buf, self.spaced)
        offsets = np.append(starts, len(kept)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        ids = list(map(self.known.get, words))
        if None in ids:
            new = [w for w, x in zip(words, ids) if x is None and w != mark]
            old = list(map(self.before.get, new))
            self.known.update((w, x) for w, x in zip(new, old) if x is not None)
            self.learn([w for w, x in zip(new, old) if x is None])
            ids = list(map(self.known.get, words))
        ids[words.index(mark)] = packed([end_id])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        long = size[codes]
        ends = np.cumsum(long)
        at = np.repeat((np.cumsum(size) - size)[codes] - (ends - long), long)
        at += np.arange(len(at))
        out = flat[at].tobytes()
        done = 4 * ends[codes == words.index(mark)]
        cuts = [0, *done.tolist()]
        return [alone.get(i) or out[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def goes_whole(self, text: str) -> bool:
        odd = not text.isascii() and ODD_SPACE.search(text) is not None
        return odd or (any(m in text for m in self.marks) and self.special.search(text) is not None)

    def learn(self, words: list[bytes]) -> None:
        odd = [w for w in words if ODD_CHUNK.search(w)]
        aside = set(odd)
        plain = [w for w in words if w not in aside]
        if plain:
            signs = b"\xff".join(plain).decode("latin-1").translate({**self.alphabet, 0xFF: "\n"}).split("\n")
            e = self.bare.encode(signs, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(plain) + 1)) * 4
            ids, ends = packed(e.ids), ends.tolist()
            for w, a, b in zip(plain, ends, ends[1:]):
                self.known[w] = ids[a:b]
        if odd:
            for w, e in zip(odd, self.whole.encode_batch([w.decode() for w in odd], add_special_tokens=False)):
                self.known[w] = packed(e.ids)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary; its cache serves later tasks."""
    return ChunkEncoder(path)


def encoded(path: str, texts: pa.Array, end_id: int, most: int = 4 << 20):
    """Yields the ids of each text and the end id, as bytes; null is empty. most: characters encoded at once."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= most:
            yield from encoder(path).encode(group, end_id)
            group, size = [], 0
    if group:
        yield from encoder(path).encode(group, end_id)
