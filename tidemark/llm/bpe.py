"""BPE encoding and decoding by batched numpy merge rounds.

Words of many texts are encoded together. Their symbols lie in one flat array; a round finds every neighbouring pair's rank
by binary search over sorted pair keys, takes each word's lowest, and merges all its places at once, left to right. A word
leaves the array when no pair of it has a rank. Encoded words are kept in a bounded table for the texts that follow.

Null texts count as empty; empty texts have no ids and decode to the empty text. Texts of any length are encoded whole.
Repeated rows are encoded alike. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches, has_unassigned

#: Words kept encoded by a Python worker, and characters of text that are encoded at once.
CACHE_WORDS, CHUNK_CHARS = 150_000, 1_000_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class WordBpe:
    """A tokenizer file with word ends (normaliser NFC and lower case, split by pattern, byte letters, merges)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), np.array([m for *_, m in pairs], np.int64)[order]
        self._compiled = None
        self.odd: set[str] = set()
        self._ids: dict[str, bytes] = {}
        self._texts: dict[str, str] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None, "odd": set(), "_ids": {}, "_texts": {}}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, all words merged together round by round."""
        raw = [w.encode("utf-8") for w in words]
        lens = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        full = lens > 0
        ends = np.cumsum(lens)
        ids[ends[full] - 1] = self.final[flat[ends[full] - 1]]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        owner = np.flatnonzero(full)
        lens = lens[full]
        while len(owner):
            starts = np.cumsum(lens) - lens
            last = np.zeros(len(ids), bool)
            last[starts + lens - 1] = True
            key = np.where(last, -1, (ids << 32) | np.roll(ids, -1))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            rank = np.where(found, self.ranks[at], _NONE)
            least = np.minimum.reduceat(rank, starts)
            pick = found & (rank == np.repeat(least, lens))
            place = np.arange(len(ids))
            opens = pick & ~np.r_[False, pick[:-1]]
            pick &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0
            ids = np.where(pick, self.made[at], ids)
            keep = ~np.r_[False, pick[:-1]]
            done = least == _NONE
            for w, a, n in zip(owner[done], starts[done], lens[done], strict=True):
                out[w] = ids[a : a + n]
            keep &= ~np.repeat(done, lens)
            lens = np.add.reduceat(keep, starts)[~done]
            ids, owner = ids[keep], owner[~done]
        return [o[o >= 0] for o in out]

    def split(self, text: str, by_library: bool = False) -> list[str]:
        """Words of a text; an added token stands as itself behind a blank, which no word holds."""
        if self._compiled is None:
            names = sorted(self.added, key=len, reverse=True)
            self._compiled = regex.compile(self.pattern), regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        words, added = self._compiled
        cut = self._library_words if by_library else lambda t: words.findall(self._normal(t))
        if added is None or not any(a in text for a in self.added):
            return cut(text)
        out: list[str] = []
        for i, part in enumerate(added.split(text)):
            out += [" " + part] if i % 2 else cut(part)
        return out

    def _library_words(self, text: str) -> list[str]:
        """The same by the tokenizers library's own Unicode tables, for texts with code points that Python's don't assign."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        plain = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return [w for w, _ in pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(plain)]

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Encode what the table of words lacks."""
        new = [w for w in words if w not in self._ids]
        if len(self._ids) + len(new) > CACHE_WORDS:
            self._ids, self._texts, self.odd, new = {}, {}, set(), list(words)
        plain = [w for w in new if w[0] != " "]
        found = dict(zip(plain, self.encode_words(plain), strict=True))
        for w in new:
            ids = found[w] if w in found else np.array([self.added[w[1:]]])
            self._ids[w] = ids.astype("<u4").tobytes()
            self._texts[w] = self.decode(ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHUNK_CHARS):
                chars += len(texts[to] or "")
                to += 1
            split = [self.split(t or "") for t in texts[at:to]]
            odd = {w for w in set().union(*split) if (w in self.odd or w not in self._ids) and has_unassigned(w)}
            if odd:
                split = [words if odd.isdisjoint(words) else self.split(t or "", True) for t, words in zip(texts[at:to], split, strict=True)]
            self.learn(set().union(*split))
            self.odd |= odd
            for words in split:
                yield b"".join(map(self._ids.__getitem__, words)), " ".join(filter(None, map(self._texts.__getitem__, words)))
            at = to


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> Column:
    """A column with a struct of n_tokens, ids_sha256 and decoded_sha256 of each whole text, and on request ids and decoded.

    The tokenizer file is read on the driver, and broadcast: its size is fixed.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe.load(path))
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.LongType())), ("decoded", T.StringType())] if ids else []

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in fields]))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, sha = shared.value, hashlib.sha256
        for texts in batches:
            rows = []
            for raw, decoded in bpe.encode(texts.tolist()):
                row = [len(raw) // 4, sha(raw).hexdigest(), sha(decoded.encode()).hexdigest()]
                rows.append(row + [np.frombuffer(raw, "<u4").astype(np.int64), decoded] if ids else row)
            yield pd.DataFrame(rows, columns=[n for n, _ in fields])

    return encode(F.col(text))


def decode_column(frame: DataFrame, path: str, ids: str = "ids") -> Column:
    """A column with the text of each array of ids; null stays null."""
    shared = frame.sparkSession.sparkContext.broadcast(WordBpe.load(path))

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda r: None if r is None else shared.value.decode(r))

    return decode(F.col(ids))


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded on request)."""
    return docs.select("doc_id", encode_column(docs, path, ids=ids).alias("_e")).select("doc_id", "_e.*")
