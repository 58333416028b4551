"""SentencePiece encoding and decoding: one Viterbi pass driven by an Aho-Corasick automaton over the pieces.

The automaton reports, at each position, every piece that ends there (its output links, longest first); each report
relaxes the best score of that position. The best path is the piece sequence with the highest sum of the model's own
scores, ties going to the longest last piece. A character that is no piece costs the lowest score less 10 and becomes
byte pieces (or the unknown id where the model has none).

Encoding marks the start of a non-empty text and every space as the model's space symbol. No piece holds that symbol
after another character, and none holds a line break, so texts are cut at those places and the parts, mostly
words, are each encoded once per worker and kept in a bounded table. A space symbol in the text itself is an unknown character, so
decoding returns every text exactly.

Defined results: null text gives null ids and 0 tokens; empty text gives no ids; very long texts are encoded whole; repeated rows get a row each;
an empty table gives none. `encode` keeps extra columns, but for any named token_ids or n_tokens, which it writes anew.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as K

#: The vocabulary file, where neither the call nor the session setting `SETTING` names one.
MODEL, SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.tremorline.pieces.model"
SPACE, KEEP = "▁", 300_000
UNKNOWN_LESS = 10.0


def load(path: str = MODEL) -> dict:
    """The vocabulary of a model file: its size is that of the file, so it can be broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i).replace(SPACE, " "), sp.get_score(i), i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {
        "pieces": pieces, "size": n, "unk": sp.unk_id(),
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)},
    }


class Coder(dict):
    """Encoder and decoder of one vocabulary; as a dict it holds the ids of parts encoded before, as 32-bit integers."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        super().__init__()
        self.older: dict[str, bytes] = {}  # what the table held when it was last full
        self.auto = ahocorasick.Automaton()
        low, pairs = 0.0, set()
        for piece, score, i in vocabulary["pieces"]:
            self.auto.add_word(piece, (len(piece), score, i))
            low = min(low, score)
            pairs.update(map(str.__add__, piece, piece[1:]))
        self.auto.make_automaton()
        self.unknown, self.pairs = low - UNKNOWN_LESS, pairs
        self.single = {p for p, _, _ in vocabulary["pieces"] if len(p) == 1}
        self.byte, self.unk = vocabulary["bytes"], vocabulary["unk"]
        table = [b""] * vocabulary["size"]
        for piece, _, i in vocabulary["pieces"]:
            table[i] = piece.encode()
        for b, i in self.byte.items():
            table[i] = bytes([b])
        self.flat, offsets = K.pack(table)
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        cut = any("\n" in p for p, _, _ in vocabulary["pieces"])
        inner = any(" " in p.lstrip(" ") for p, _, _ in vocabulary["pieces"])
        self.parts = re.compile(r"(?s).+" if inner else r" *[^ ]+| +" if cut else r" *[^ \n]+| +|\n").findall

    def best(self, part: str) -> list[int]:
        """The single-pass Viterbi over one part."""
        n = len(part)
        score, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        odd = [] if self.single.issuperset(part) else [i for i, c in enumerate(part) if c not in self.single]
        for end, piece in self.auto.iter(part):
            while odd and odd[0] <= end:  # characters that are no piece, up to here
                p = odd.pop(0)
                score[p + 1], back[p + 1] = score[p] + self.unknown, (1, 0.0, -1)
            end += 1
            s = score[end - piece[0]] + piece[1]
            if s > score[end]:
                score[end], back[end] = s, piece
        for p in odd:
            score[p + 1], back[p + 1] = score[p] + self.unknown, (1, 0.0, -1)
        out, at = [], n
        while at:
            size, _, i = back[at]
            at -= size
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte.get(b, self.unk) for b in reversed(part[at].encode())] if self.byte else [self.unk]
        out.reverse()
        return out

    def __missing__(self, part: str) -> bytes:
        """Encodes a part, cut further wherever no piece holds the two characters side by side."""
        ids = self.older.get(part)
        if ids is not None:
            self[part] = ids
            return ids
        pairs = self.pairs
        cuts = [i for i, p in enumerate(map(str.__add__, part, part[1:]), 1) if p not in pairs]
        if cuts:
            ids = b"".join([self[part[i:j]] for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True)])
        else:
            ids = array("i", self.best(part)).tobytes()
        if len(part) <= 64:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(" " + text))) if text else b""

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.flat[K.ranges(self.starts[ids], self.sizes[ids])].tobytes().decode("utf-8", "replace")[1:]


_coders: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    """One coder per worker process and vocabulary."""
    key, vocabulary = shared.value
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def _share(spark: SparkSession, path: str | None):
    K.ship(spark)
    vocabulary = load(path or spark.conf.get(SETTING, MODEL))
    return spark.sparkContext.broadcast((hashlib.sha1(repr(vocabulary).encode()).hexdigest(), vocabulary))


def _lists(rows: list[bytes], nulls: list[bool]) -> tuple[pa.Array, np.ndarray]:
    sizes = np.array([len(r) // 4 for r in rows], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)), mask=pa.array(nulls)), sizes


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of docs, then token_ids (array<int>) and n_tokens, in one narrow pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = _share(docs.sparkSession, path)
    names = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    src = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    text = f"_{names.index(text_col)}"
    spec = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.schema] + ["token_ids array<int>", "n_tokens long"])
    arrow = to_arrow_schema(src.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # bounds the ids held as Python lists
                part = batch.slice(at, 1000)
                texts = part.column(text).to_pylist()
                ids, sizes = _lists([coder.packed(t) if t else b"" for t in texts], [t is None for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(sizes)], names=[*arrow.names, "token_ids", "n_tokens"])

    out = src.mapInArrow(run, spec)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "token_ids", "n_tokens")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids and the decoded text of each id list."""
    shared = _share(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column("token_ids")
                flat, ends, nulls = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_null().to_pylist()
                texts = [None if gone else coder.decode(flat[a:b]) for a, b, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), nulls, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return tokens.select("doc_id", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the decoded text's length and SHA-256 (null where the text is null)."""
    out = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path), path)
    return out.select("doc_id", "n_tokens", "token_ids", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
