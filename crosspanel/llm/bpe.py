"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (operator 9).

Long texts are cut first at places where a match of the pattern always starts: a space or line break after a
character that is no white space. The cuts keep the library's working set small and change no token.

Defined cases: a null or empty text has no tokens and decodes to nothing; repeated rows give repeated rows; an
empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches, texts_of

LONG_TEXT = 1 << 14


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of about `size` characters; a stretch without a safe boundary stays whole."""
    if len(text) <= size:
        return [text]
    out, begin, at = [], 0, size
    following = dict.fromkeys(" \n", -1)  # the next place of each, found once and kept until it is passed
    while at < len(text):
        for c, place in following.items():
            if place < at:
                place = text.find(c, at)
                following[c] = place if place >= 0 else len(text)
        at = min(following.values())
        if at == len(text):
            break
        if text[at - 1].isspace():
            at += 1
            continue
        out.append(text[begin:at])
        begin, at = at, at + size
    return [*out, text[begin:]]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    return [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and with keep_ids the ids and the decoded bytes."""
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if keep_ids:
        types |= {"ids": pa.list_(pa.int32()), "decoded": pa.binary()}

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = {k: [] for k in types}
            out["doc_id"] = b.column(0)
            for text in b.column(1):
                ids = encode(enc, text.as_py())
                decoded = enc.decode_bytes(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
            yield arrow_rows(out, types)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return texts_of(docs).mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table of doc_id and ids; null ids decode to nothing."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            yield arrow_rows({"doc_id": b.column(0), "decoded": [enc.decode_bytes(x.as_py() or []) for x in b.column(1)]}, {"doc_id": pa.int64(), "decoded": pa.binary()})

    bounded_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded binary")
