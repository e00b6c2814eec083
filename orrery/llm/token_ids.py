"""Problem 7: token ids of whole texts with a public tokenizer, and the way back through raw bytes."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies, the same on every executor.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in pieces of about this length.
PIECE_CHARS = 16_384
#: A place where the pattern always ends one match and begins another: after a letter or digit, before a blank, a line
#: break or an East Asian stop. No alternative crosses it, and none looks behind.
SAFE = re.compile(r"[^\W_](?=[ \n。，、])")


@lru_cache(maxsize=4)
def encoding(tokenizer: str, folder: str = TOKENIZERS):
    """The tokenizer of a rank file ``<folder>/<tokenizer>.tiktoken``, loaded once per worker; no special tokens."""
    import tiktoken

    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(tokenizer, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe places only; their ids put together are the ids of the text."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.end()])
        at = cut.end()
    out.append(text[at:])
    return out


def encode(text: str | None, enc) -> list[int]:
    """Ids without special tokens (a special token's name is plain text); null and empty texts have none."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], enc) -> str:
    """The text of the ids, by joining the raw bytes of the tokens (a token may end within a character)."""
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def _worker(tokenizer: str, folder: str, lengths: bool):
    def run(batches):
        enc = encoding(tokenizer, folder)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                ids = [encode(t, enc) for t in part["text"].to_pylist()]
                if lengths:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in ids], pa.int32())], ["doc_id", "n_tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids array<int>: one row per row of ``documents``, in any order.

    A null or empty text has the empty list; blanks and control characters are ordinary text. Repeated rows stay
    repeated; a null doc_id stays null; other columns are ignored. Nothing is shuffled: texts go to Python in Arrow
    batches, however long, and only two columns are read.
    """
    return documents.select("doc_id", "text").mapInArrow(_worker(tokenizer, folder, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens: as :func:`token_ids`, lengths only."""
    return documents.select("doc_id", "text").mapInArrow(_worker(tokenizer, folder, True), "doc_id bigint, n_tokens int")


def _back(tokenizer: str, folder: str):
    def run(batches):
        enc = encoding(tokenizer, folder)
        for batch in batches:
            texts = [None if ids is None else decode(ids, enc) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def texts_of(ids: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text of (doc_id, ids); the inverse of :func:`token_ids` but for null texts, which come back empty."""
    return ids.select("doc_id", "ids").mapInArrow(_back(tokenizer, folder), "doc_id bigint, text string")


def _there_and_back(tokenizer: str, folder: str):
    def run(batches):
        enc = encoding(tokenizer, folder)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts = [t or "" for t in part["text"].to_pylist()]
                ids = [encode(t, enc) for t in texts]
                same = [decode(i, enc) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(i) for i in ids], pa.int32()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "same"])

    return run


def round_trips(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens, same: whether the ids of each text decode to it again (a null text counts as empty). One pass, no shuffle."""
    return documents.select("doc_id", "text").mapInArrow(_there_and_back(tokenizer, folder), "doc_id bigint, n_tokens int, same boolean")
