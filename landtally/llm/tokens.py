"""Token counts of whole texts with a byte-level BPE, most words without running it.

A text falls into pre-tokens; each is merged on its own. Offline, once per worker, every
vocabulary string is encoded alone: those that come back as one token are proven whole, and a
pre-token equal to one of them counts 1. Only the remaining pre-tokens are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE_ENTRIES = 400_000

#: A single space between two non-spaces always begins a pre-token, so a text can be cut there.
_SPACE = r"\s᠎​⁠﻿"
_CUT = re.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_ODD = re.compile(rf" [{_SPACE}]|[{_SPACE}] |^ | $|[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: Characters whose classes are beyond doubt; pieces with others go to the tokenizer itself.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
#: The published split pattern for texts of such characters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


class Counter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` yields them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        to_char = self._byte_chars()
        self.chars = {b: c for b, c in enumerate(to_char)}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = self._whole(to_char, added)
        self.pieces = _Pieces(self)

    def _byte_chars(self) -> list[str]:
        """The character that stands for each byte: printable Latin-1 for itself, others from 256 on."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        out, further = [], 256
        for b in range(256):
            out.append(chr(b if b in plain else further))
            further += b not in plain
        return out

    def _whole(self, to_char: list[str], added: set[str]) -> set[str]:
        """Vocabulary strings that, encoded alone, are proven to be one token."""
        back = {c: b for b, c in enumerate(to_char)}
        texts = []
        for name in self.tokenizer.get_vocab():
            if name not in added and all(c in back for c in name):
                try:
                    texts.append(bytes(back[c] for c in name).decode())
                except UnicodeDecodeError:
                    continue
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return {t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1}

    def merged(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(self.chars)))

    def piece(self, text: str) -> int:
        """Tokens of a plain stretch that begins and ends with pre-tokens."""
        whole = self.whole
        return sum([1 if p in whole else self.merged(p) for p in _SPLIT(text)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        encode = self.tokenizer.encode
        if self.added is not None and self.added.search(text):
            return len(encode(text, add_special_tokens=False).ids)
        first, *rest = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        if not _PLAIN.fullmatch(text):
            return sum(self.piece(p) if _PLAIN.fullmatch(p) else len(encode(p, add_special_tokens=False).ids)
                       for p in [first, *[" " + p for p in rest]])
        pieces = self.pieces
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        return self.piece(first) + sum(map(pieces.__getitem__, rest))


class _Pieces(dict):
    """Token counts of plain words after a space."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        counter, text = self.counter, " " + word
        if word.isalpha():
            n = 1 if text in counter.whole else counter.merged(text)
        else:
            n = counter.piece(text)
        self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per document row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Whole texts, no added special tokens, no truncation or padding; strings of special tokens inside
    a text count as the tokenizer takes them. NULL and empty texts have 0 bytes and tokens, and a NULL
    id is returned as it is. Repeated rows each return a row; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
                        F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_count(tokenizer_path), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
