"""Token ids and counts of whole texts by the library's vocabulary, with most pre-tokens looked up."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers; the memory is emptied when full, so it bounds memory and not results.
REMEMBERED = 400_000
#: The published split pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: All characters but those of ranges on which the split patterns of all engines agree, whatever Unicode version
#: they were built with. A text with one of them goes to the library whole.
DOUBTFUL = "[^\\x00-\\x1b\\x20-\\x84\\x86-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u4e00-\u9fa5\uac00-\ud7a3]"


def default_vocabulary() -> str:
    """The byte-level vocabulary among the public tokenizers; the path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids as the library gives them without special tokens added, by pre-token.

    The whole-token shortcut: a vocabulary string that splits into one pre-token, itself, and that the model
    encodes alone as one token always is that token; this is proved for each string when the encoder is made.
    Other pre-tokens are merged by the library's model and remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.find = regex.compile(PATTERN).findall
        self.doubtful = regex.compile(DOUBTFUL).search
        self.letters = str.maketrans({chr(i): c for i, c in enumerate(byte_letters())})
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]

    @cached_property
    def whole(self) -> dict[str, bytes]:
        return self.prove(self.vocabulary) if self.plain else {}

    @cached_property
    def ids(self) -> dict[str, bytes]:
        return dict(self.whole)

    def prove(self, vocabulary: dict[str, int]) -> dict[str, bytes]:
        back = {c: i for i, c in enumerate(byte_letters())}
        found = {}
        for token, k in vocabulary.items():
            try:
                text = bytes(back[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text and not self.doubtful(text) and self.find(text) == [text] and [x.id for x in self.model.tokenize(token)] == [k]:
                found[text] = k.to_bytes(4, "little")
        return found

    def merge(self, pre_token: str) -> bytes:
        ids = b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(pre_token.encode("utf-8").decode("latin-1").translate(self.letters)))
        if len(self.ids) >= REMEMBERED + len(self.whole):
            self.ids = dict(self.whole)
        self.ids[pre_token] = ids
        return ids

    def library_only(self, text: str) -> bool:
        return not self.plain or bool(self.doubtful(text)) or any(s in text for s in self.special)

    def pieces(self, text: str) -> list[bytes] | None:
        """The ids of each pre-token as little-endian 32-bit words; None if the library must take the text whole."""
        if self.library_only(text):
            return None
        found = self.find(text)
        out = list(map(self.ids.get, found))
        if None in out:
            out = [self.ids.get(p) or self.merge(p) for p in found]
        return out

    def count(self, text: str) -> int:
        out = self.pieces(text)
        return len(self.library.encode(text, add_special_tokens=False).ids) if out is None else sum(map(len, out)) // 4

    @cached_property
    def ranked(self):
        """The same vocabulary in the byte-pair library that is quickest at ids: a token's rank is its id."""
        import tiktoken

        back = {c: i for i, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in token): k for token, k in self.vocabulary.items()}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.library_only(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            # Its regex engine backtracks over white space and gives up on runs of some hundred thousand.
            return np.frombuffer(b"".join(self.pieces(text) or ()), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    One pass, no shuffle. A null text is empty and has 0 tokens; long texts are counted whole, one at a time;
    rows that repeat are counted each; an empty table gives an empty result; other columns are not read. The
    vocabulary file must be at the same path on every machine.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts = [enc.count(t.as_py() or "") for t in b.column(1)]
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": b.column(2), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
