"""Token ids of public vocabularies, as the `tokenizers` library gives them."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

END = 1  # the id after every document
SPECIAL = "<|endoftext|>"
#: Letters, digits and spaces that all Unicode versions and regex engines class alike.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
LONG_RUN = 8192
#: The ranked encoder steps back over white space with a stack frame a character, so long runs go to the library.
RUN = re.compile(r"\s{%d}" % LONG_RUN)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """The ids of byte_bpe_50k.json; END after each text.

    Plain texts go through the same vocabulary as ranks, which is five times
    as fast and gives the same ids; texts with special strings, characters
    beyond Latin or very long white space go to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path, self.ranks_path = json_path, ranks_path

    def __call__(self, text: str | None) -> np.ndarray:
        t = text or ""
        if SPECIAL not in t and (t.isascii() and t.isprintable() or not ODD.search(t)) and (len(t) < LONG_RUN or not RUN.search(t)):
            ids = _ranked(self.ranks_path).encode_ordinary(t)
        else:
            ids = library(self.json_path).encode(t, add_special_tokens=False).ids
        ids.append(END)
        return np.array(ids, dtype=np.uint16)


def byte_encoder() -> ByteEncoder:
    return ByteEncoder(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def squeeze(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(ids.astype("<u2").tobytes())


def unsqueeze(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<u2")


def token_rows(encoder):
    """For mapInArrow over (id, source, text): (part, row, id, source, n, ids), ids compressed."""

    def run(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                ids = [encoder(t) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(range(row, row + len(ids)), pa.int64()),
                        some.column(0),
                        some.column(1),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([squeeze(x) for x in ids], pa.binary()),
                    ],
                    names=["part", "row", "id", "source", "n", "ids"],
                )
                row += len(ids)

    return run
