"""BPE encoding by backtracking over longest token matches, decoding through an offset table.

A word is encoded from left to right: the Aho-Corasick automaton of the vocabulary (here the dictionary of all
tokens with each token's longest proper prefix token) gives the longest match at the current place; a token may
follow the one before it only if the pair is compatible, that is if merging by rank would not join across
their border; on a conflict the next shorter prefix is tried, then the token before is taken back. Every byte
position is visited at most once for each state of a bit field, so time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import trim

DEFAULT_VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 100_000
"""Most distinct words in each of the two generations of encodings that a worker keeps."""

LONG_WORD = 100
"""Words of more characters are not kept."""


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _lower(text: str) -> str:
    """Each character on its own: unlike str.lower(), a final sigma is no special case."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Cache:
    """Two generations of words: a full new one becomes the old one."""

    def __init__(self):
        self.new: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def turn(self) -> tuple[dict, dict]:
        self.new, self.old = {}, self.new
        return self.new, self.old


PAIRS = 1 << 17
"""Most pairs whose compatibility a worker remembers; then it starts anew. Any number gives the same tokens."""


class Codec:
    """An encoder and decoder for a BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        self.space = regex.compile(r"\s+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        # A piece is a tuple of symbols: letters, the last with the word end. In text the end is one private letter.
        self.mark = "\ue000"
        spell = lambda t: t[: -len(self.end)] + self.mark if self.end and t.endswith(self.end) else t
        self.spelled = {spell(t): i for t, i in self.vocab.items()}
        self.text_of = {i: t for t, i in self.spelled.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, joined token)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right) of its first merge
        for (a, b), (r, t) in self.rank.items():
            if t not in self.parts or r < self.parts[t][0]:
                self.parts[t] = (r, a, b)
        # Only tokens that merging really forms can take part in an encoding.
        self.formed = {i for s, i in self.spelled.items() if self._merge(s) == [i]}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.spelled.items():
            if i in self.formed:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.shorter = {i: next((self.spelled[s[:k]] for k in range(len(s) - 1, 0, -1) if self.spelled.get(s[:k]) in self.formed), None) for s, i in self.spelled.items() if i in self.formed}
        self.compatible: dict[int, bool] = {}  # left << 32 | right
        # decoding: all tokens' texts in one string, token i from offset[i] to offset[i + 1]
        texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(texts) + 1
        self.offsets = np.cumsum([0, *(len(texts.get(i, "")) for i in range(size))]).tolist()
        self.all_text = "".join(texts.get(i, "") for i in range(size))

    def _merge(self, word: str) -> list[int]:
        """Merging by rank, for building the tables."""
        ids = [self.spelled[c] for c in self._symbols(word)]
        while len(ids) > 1:
            found = [(self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not found:
                break
            _, k = min(found)
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _symbols(self, word: str) -> list[str]:
        if len(word) > 1 and word[-1] == self.mark:
            return [*word[:-2], word[-2:]]
        return list(word)

    def _fits(self, left: int, right: int) -> bool:
        """Would merging by rank leave left and right apart where they stand side by side?

        Undo both tokens' merges, latest first: if at some depth the two border tokens have a merge that comes
        before those that formed the tokens around them, it would have been made and the border is impossible.
        """
        known = self.compatible.get(left << 32 | right)
        if known is not None:
            return known
        a, b, limit, out = left, right, 1 << 60, True
        while True:
            joined = self.rank.get((a, b))
            if joined is not None and joined[0] < limit:
                out = False
                break
            ra, rb = self.parts.get(a, (-1, 0, 0))[0], self.parts.get(b, (-1, 0, 0))[0]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the later merge is undone first; equal ranks: the left one was made first
                limit, a = ra, self.parts[a][2]
            elif rb > ra:
                limit, b = rb + 1, self.parts[b][1]
            else:
                limit, b = rb + 1, self.parts[b][1]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[left << 32 | right] = out
        return out

    def _longest(self, word: str) -> list[int | None]:
        """For each place the longest token that starts there: one run of the automaton over the word."""
        best: list[int | None] = [None] * len(word)
        length = [0] * len(word)
        for at, (n, i) in self.automaton.iter(word):
            s = at - n + 1
            if n > length[s]:
                best[s], length[s] = i, n
        return best

    def encode_word(self, word: str) -> list[int]:
        """word: byte letters, with the word end's mark. Exact merges of the whole word."""
        longest = self._longest(word)
        n = len(word)
        dead = bytearray(n + 1)  # places from which no compatible rest exists
        out: list[int] = []
        ends: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            size = 0
            while token is not None:
                size = len(self.text_of[token])
                if not dead[at + size] and not (size + at < n and word[at + size] == self.mark) and (not out or self._fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                ends.append(at)
                at += size
                token = longest[at] if at < n else None
            else:
                if not out:  # cannot happen with a sound vocabulary; merging by rank is always right
                    return self._merge(word)
                dead[at] = 1
                last = out.pop()
                at = ends.pop()
                token = self.shorter[last]
        return out

    def words(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Pre-tokens as (byte letters with the end's mark, None) or ('', id of a special token)."""
        for k, part in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
            if k % 2:
                yield "", self.special[part]
            elif part:
                for w in self.pattern.findall(_lower(self.space.sub(" ", unicodedata.normalize("NFC", part)))):
                    yield w, None

    def spell(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode("utf-8", "replace")]) + (self.mark if self.end else "")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word, special in self.words(text):
            out += [special] if special is not None else self.encode_word(self.spell(word))
        return out

    def tokens(self, ids: list[int]) -> list[str]:
        o, t = self.offsets, self.all_text
        return [t[o[i] : o[i + 1]] for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by single spaces, as the library does then."""
        return " ".join(self.tokens(ids))

    def digest(self, text: str, cache: Cache) -> tuple[int, str, str]:
        """Count, decimal ids joined by spaces, decoded text: of the words' parts, kept by word."""
        parts = []
        new, old = cache.new, cache.old
        for word, special in self.words(text):
            got = new.get(word) if special is None else None
            if got is None:
                got = old.get(word) if special is None else None
                if got is None:
                    ids = [special] if special is not None else self.encode_word(self.spell(word))
                    got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                if special is None and len(word) <= LONG_WORD:
                    new[word] = got
                    if len(new) >= CACHE_WORDS:
                        new, old = cache.turn()
            parts.append(got)
        if not parts:
            return 0, "", ""
        n, ids, decoded = zip(*parts)
        return sum(n), " ".join(ids), " ".join(decoded)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): a row for each row of docs, repeated rows and null ids among them; a null text counts as
    empty. path must exist on every executor; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), a row for each row; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i.as_py() or []) for i in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a row for each row of docs; a null text counts as empty.

    Repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cache = codec(path), Cache()
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = [c.digest(t.as_py() or "", cache) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sha(i) for _, i, _ in rows]), pa.array([sha(d) for _, _, d in rows])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del cache
        trim()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
