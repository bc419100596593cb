"""Byte-level BPE encoding and decoding over Arrow batches.

Every text is cut by the vocabulary's pattern; each distinct piece of a task is encoded once by the
``tokenizers`` library and kept in a bounded dictionary. Offsets come from byte lengths: the end of each
token in bytes is a running sum, and a byte maps to the character that holds it, so a character that is
split over several tokens is given to each of them. Decoding looks the bytes of each id up, joins them and
only then reads UTF-8, so split characters come back whole.

Null and empty texts have no ids. Rows don't meet, so repeated rows and ids have repeated results and an empty
table gives none; long texts are cut a few at a time. Columns beside those named are kept or ignored as each
function says.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import by_size, map_batches, table, text_or_empty

#: Letters outside ASCII for which the plain pattern below is exact; texts with any other character outside
#: ASCII are cut by the tokenizer itself.
LATIN = "À-ÖØ-öø-ÿ"
#: The tokenizer's pattern for texts of ASCII and LATIN.
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
OTHER = re.compile(rf"[^\x00-\x7f{LATIN}]")
#: Distinct pieces kept by a task before the dictionary starts afresh; it changes speed, never results.
KEPT_PIECES = 150_000
#: Characters of text that are cut into pieces at once, or one text; it bounds memory, never results.
CUT_CHARS = 500_000


class Codec:
    """Encodes and decodes with one vocabulary: the ``tokenizers`` file and the byte string of every id."""

    def __init__(self, tokenizer_json: bytes, id_bytes: dict[int, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.id_bytes = id_bytes
        self.pieces: dict[str, bytes] = {}
        self.lengths = np.zeros(max(id_bytes) + 1, np.int64)
        for k, v in id_bytes.items():
            self.lengths[k] = len(v)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for group in by_size(texts, CUT_CHARS) for ids in self._encode(group)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        cut = [None if OTHER.search(t) else PLAIN.findall(t) for t in texts]
        new = list(set().union(*(c for c in cut if c is not None)).difference(self.pieces))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.pieces[piece] = np.array(e.ids, "<u4").tobytes()
        get = self.pieces.__getitem__
        return [b"".join(map(get, c)) if c is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, c in zip(texts, cut)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of the ids; KeyError for an id outside the vocabulary."""
        return b"".join(map(self.id_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """Start and end character of each token; a character split over tokens belongs to each of them."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char[starts].tolist(), (char[ends - 1] + 1).tolist()


def load_vocabulary(json_path: str, ranks_path: str) -> tuple[bytes, dict[int, bytes]]:
    """Read both vocabulary files on the driver (a few MB, fixed); tasks get their content, not paths."""
    with open(json_path, "rb") as f:
        whole = f.read()
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return whole, ranks


def _codec(spark: SparkSession, json_path: str | None, ranks_path: str | None):
    if json_path is None or ranks_path is None:
        import public_tokenizers

        json_path, ranks_path = json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared = spark.sparkContext.broadcast(load_vocabulary(json_path, ranks_path))
    return lambda: Codec(*shared.value)


def encode(docs: DataFrame, text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int), ``starts`` and ``ends`` (arrays of long, characters) to every row.

    Null and empty texts give empty arrays. Every other column is kept; the three names replace columns of
    the same name. Repeated rows stay repeated.
    """
    make, keep = _codec(docs.sparkSession, json_path, ranks_path), [c for c in docs.columns if c not in ("ids", "starts", "ends")]

    def start():
        codec = make()

        def run(cols):
            texts = [x or "" for x in cols.pop("__text")]
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in codec.encode(texts)]
            spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
            return cols | {"ids": [x.tolist() for x in ids], "starts": [x[0] for x in spans], "ends": [x[1] for x in spans]}

        return run

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return map_batches(docs.select(*keep, text_or_empty(text_col).alias("__text")), f"{fields}{', ' * bool(fields)}ids array<int>, starts array<bigint>, ends array<bigint>", start)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Add the text of ``ids_col`` as ``out_col``; bytes that aren't UTF-8 become U+FFFD, null ids the empty text."""
    make, keep = _codec(rows.sparkSession, json_path, ranks_path), [c for c in rows.columns if c != out_col]

    def start():
        codec = make()
        return lambda cols: {k: v for k, v in cols.items() if k != "__ids"} | {out_col: [codec.decode_bytes(x or []).decode("utf-8", "replace") for x in cols["__ids"]]}

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return map_batches(rows.select(*keep, F.col(ids_col).alias("__ids")), f"{fields}`{out_col}` string", start)


def encode_digest(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, and SHA-256 of the ids and of the bytes that they decode to."""
    make = _codec(docs.sparkSession, json_path, ranks_path)

    def start():
        codec = make()

        def run(cols):
            ids = codec.encode([x or "" for x in cols["text"]])
            return {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode_bytes(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids],
            }

        return run

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start, rows=1024)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids and of decoded bytes of every document."""
    return encode_digest(table(spark, sf_dir, "documents"))
