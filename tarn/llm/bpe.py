"""Byte-pair encoding and decoding with a given vocabulary.

Texts are normalised (NFC, lower case) and split into words as the vocabulary file says. A
worker encodes each distinct word once: the symbols of all new words of a batch lie in one flat
array, every adjacent pair becomes one integer key, a binary search over the sorted keys of the
merge table gives its rank, and each round merges the lowest-ranked pair of every word at once.
Words that have no pair left leave the array, so the work of a round is what is still moving.

Edge cases: a null or empty text has no tokens; special-token strings inside a text become
their special ids, as the vocabulary's own library does; repeated rows are encoded each; texts of any
length are encoded whole, batch by batch of bounded bytes; an empty table gives an empty result.
Unicode tables are those of Python and ``regex``: code points assigned after them may split
differently than in another library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Chunks of text in each of the two cache generations of a worker; bounds its memory, never the result.
CACHE_WORDS = 300_000

ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a word-end BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab |= self.special
        self.size = max(vocab.values()) + 1
        self.tokens = [""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], np.arange(len(keys))[order], merged[order]
        # If each token is made by one merge, after its parts, all occurrences of a word's
        # lowest pair can merge in one round; otherwise only the leftmost may.
        made = np.full(self.size, -1, np.int64)
        made[merged] = np.arange(len(merged))
        self.at_once = bool(
            len(np.unique(merged)) == len(merged)
            and (np.maximum(made[left], made[right]) < np.arange(len(merged))).all()
        )
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = [str(i) for i in range(self.size)]
        self.encoded: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    @classmethod
    def from_file(cls, path: str) -> BpeCodec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (non-empty UTF-8 bytes) in one array, and where each word's begin and end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        owner, ended = [word[:0]], [symbols[:0]]
        none = np.int64(len(self.keys))
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            stuck = least == none
            moving = ~np.repeat(stuck, sizes)
            owner.append(word[~moving])
            ended.append(symbols[~moving])
            of = np.repeat(least, sizes)
            chosen = (rank == of) & (of != none)
            if self.at_once:
                # In a run such as "aaa" the pairs overlap: take every other one from the left.
                position = np.arange(len(chosen))
                begins = chosen & ~np.append(False, chosen[:-1] & (word[1:] == word[:-1]))
                since = position - np.maximum.accumulate(np.where(begins, position, 0))
                chosen &= since % 2 == 0
            else:
                position = np.flatnonzero(chosen)
                first = np.append(True, word[position[1:]] != word[position[:-1]]) if len(position) else position
                chosen = np.zeros(len(chosen), bool)
                chosen[position[first]] = True
            hit = np.flatnonzero(chosen)
            symbols[hit] = self.merged[at[hit]]
            moving[hit + 1] = False
            symbols, word = symbols[moving], word[moving]
        of = np.concatenate(owner)
        order = np.argsort(of, kind="stable")
        return np.concatenate(ended)[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def _lines(self, words: list[str]) -> list[tuple[str, str]]:
        """Of each word the ids as a line and the decoded tokens."""
        found: list[tuple[str, str]] = []
        for begin in range(0, len(words), 50_000):
            ids, bounds = self.merge_words([w.encode() for w in words[begin : begin + 50_000]])
            listed, at = ids.tolist(), bounds.tolist()
            names, tokens = [self.names[i] for i in listed], [self.tokens[i] for i in listed]
            found += [(" ".join(names[i:j]), " ".join(tokens[i:j])) for i, j in zip(at, at[1:])]
        return found

    def _learn(self, chunks: set[str]) -> None:
        """Puts all of ``chunks`` into the younger of the two cache generations."""
        new = chunks - self.encoded.keys()
        if len(self.encoded) + len(new) > CACHE_WORDS:
            self.older, self.encoded, self.decoded = (self.encoded, self.decoded), {}, {}
            new = chunks
        encoded, decoded = self.older
        known = new & encoded.keys()
        for c in known:
            line = self.encoded[c] = encoded[c]
            self.decoded[line] = decoded[line]
        new = new - known
        parts = {c: [c] if c[:1] == "\0" and c[1:] in self.special else self.words.findall(c) for c in new}
        words = list({w for p in parts.values() for w in p})
        plain = [w for w in words if w[:1] != "\0" or w[1:] not in self.special]
        of = dict(zip(plain, self._lines(plain), strict=True))
        of |= {"\0" + t: (str(i), t) for t, i in self.special.items()}
        for c, p in parts.items():
            line, text = of[p[0]] if len(p) == 1 else (" ".join([of[w][k] for w in p]) for k in (0, 1))
            self.encoded[c], self.decoded[line] = line, text

    def normalise(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # one code point at a time: no final form
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that no token crosses; special-token strings are marked by a leading NUL."""
        if self.split_special is None or "<|" not in text:
            return self._plain(text)
        found: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            found += ["\0" + part] if k % 2 else self._plain(part)
        return found

    def _plain(self, text: str) -> list[str]:
        text = self.normalise(text)
        # No word holds white space. str.split() also splits at U+001C-1F, which words may hold.
        return self.words.findall(text) if ODD.search(text) else text.split()

    def id_lines(self, texts: list[str]) -> list[list[str]]:
        """For each text the ids of its chunks, each chunk's as decimal numbers joined by a space."""
        cut = [self.chunks(t) for t in texts]
        self._learn(set().union(*cut))
        known = self.encoded.__getitem__
        return [list(map(known, chunks)) for chunks in cut]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for line in self.id_lines([text or ""])[0] for i in line.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: the vocabulary names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def decode_lines(self, lines: list[str]) -> str:
        """The decoded text for lines of ids that ``id_lines`` has just returned."""
        return " ".join(map(self.decoded.__getitem__, lines))


_codecs: dict[tuple[int, int], BpeCodec] = {}


def codec_of(shared) -> BpeCodec:
    """One codec for each worker process and broadcast vocabulary."""
    key = len(shared.value), hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec(json.loads(shared.value))
    return _codecs[key]


def broadcast_vocabulary(spark, path: str):
    """The vocabulary file as a broadcast; its size is that of the file, not of the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Characters of text encoded together; a longer text is a group of its own.
GROUP_CHARS = 4_000_000


def grouped(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    chars = 0
    for t in texts:
        if group and chars + len(t) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text of ``docs``.

    Returns the columns ``keep`` with n_tokens, ids_sha256 (of the decimal ids joined by one
    space) and decoded_sha256, and with ``ids`` (array<int>) and ``decoded`` if asked for.
    """
    spark = prepare(docs.sparkSession)
    shared = broadcast_vocabulary(spark, path)
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            count, digest, back, ids, decoded = [], [], [], [], []
            for group in grouped(texts):
                for lines in codec.id_lines(group):
                    joined = " ".join(lines)
                    text_back = codec.decode_lines(lines)
                    count.append(joined.count(" ") + 1 if joined else 0)
                    digest.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(text_back.encode()).hexdigest())
                    if with_ids:
                        ids.append([int(x) for x in joined.split()])
                        decoded.append(text_back)
            columns = [*batch.columns[:-1], pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
