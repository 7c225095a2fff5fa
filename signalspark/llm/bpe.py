"""Byte-level BPE: encoding of whole texts by a local rank file, and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from signalspark.llm.textmap import with_text_columns

RANKS = "byte_bpe_50k.tiktoken"
#: Texts are cut into pieces of about so many characters.
PIECE = 1 << 16
#: White space as the splitting pattern's engine sees it (Unicode White_Space, fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are encoded apart: the engine recurses over them.
LONG_RUN = 4096
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
#: No match of the pattern goes from a non-space into a space that follows it.
_CUT = re.compile(rf"(?<=[^\s{SPACE}])(?=[ \t\r\n])")


def encoding(rank_file: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """An encoding without special tokens from the bytes of a rank file."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cut a text where matches of the pattern must end: (piece, is one match).

    A cut lies between a non-space and a white-space character.  A run of white
    space of ``LONG_RUN`` or more is one match up to its last character, which
    may belong to the next word; at the end of the text it is one match whole.
    Text without such places stays in one piece, however long.
    """
    at = 0
    for run in [*_RUN.finditer(text), None]:
        end = run.start() if run else len(text)
        while end - at > size and (cut := _CUT.search(text, at + size, end)) and cut.start() < end:
            yield text[at : cut.start()], False
            at = cut.start()
        if at < end:
            yield text[at:end], False
            at = end
        if run:
            stop = run.end() - (run.end() < len(text))
            yield text[at:stop], True
            at = stop


def encode(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    """Token ids of a whole text as little-endian unsigned 32-bit integers."""
    parts = [
        np.array(enc._encode_single_piece(p) if single else enc.encode_ordinary(p), dtype="<u4")
        for p, single in pieces(text, size)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def decode(enc: tiktoken.Encoding, ids: np.ndarray, size: int = PIECE) -> bytes:
    """Raw bytes of token ids; they need not end at character borders."""
    return b"".join(enc.decode_bytes(ids[i : i + size].tolist()) for i in range(0, len(ids), size))


def encode_documents(
    documents: DataFrame,
    rank_path: str | None = None,
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = False,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds ``n_tokens`` (long), ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (of the decoded bytes) and,
    if asked, ``ids`` (array of int) to the columns in ``keep``.  A null text
    counts as empty: no ids and the hash of nothing.  One row per row, repeated
    rows and null ids included; an empty table gives an empty result.  Columns
    of the same names are replaced.

    The rank file is read by the driver and broadcast: about 1 MB, whatever the
    corpus.  No shuffle; a lost executor costs its own tasks only.
    """
    with open(rank_path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def task():
        enc = encoding(ranks.value, pattern)

        def run(texts):
            n, hashed, decoded, lists = [], [], [], []
            for t in texts:
                ids = encode(enc, t or "")
                n.append(len(ids))
                hashed.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            return [n, hashed, decoded, *([lists] if with_ids else [])]

        return run

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return with_text_columns(documents, task, fields, text, keep)
