"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut to words in Python workers; each batch's distinct words are encoded by recursive DuckDB queries: rows of
(word, position, token) join the merge table, each step contracts every word's pair of least rank, from the left, until
no word has a pair left; ordered aggregation gives the ids, and decodes them. A step takes all places of that pair that
don't overlap: what it makes only has pairs of higher rank, so the next leftmost ones would be the same.
Known words are kept between batches of a task, in a bounded cache.
"""

from __future__ import annotations

import importlib.util
import itertools
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame

#: Words kept between batches of a task; bytes of the words that a query encodes at once (a longer word has its own).
CACHE_WORDS, QUERY_BYTES = 200_000, 200_000
# Fixed value: the tokenizer's pattern of words, as published.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CONTRACT = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM pieces
  UNION ALL
  SELECT w, p, CASE WHEN takes THEN made WHEN lag(takes) OVER (PARTITION BY w ORDER BY p) THEN NULL ELSE t END
  FROM (
    SELECT w, p, t, made, hit AND (n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY w ORDER BY p), 0)) % 2 = 1 AS takes
    FROM (
      SELECT w, p, t, n, made, best, rank IS NOT NULL AND rank = best AS hit
      FROM (
        SELECT w, p, t, n, m.rank, m.made, min(m.rank) OVER (PARTITION BY w) AS best
        FROM (
          SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS after, row_number() OVER (PARTITION BY w ORDER BY p) AS n
          FROM step WHERE t IS NOT NULL
        ) x LEFT JOIN merges m ON m.a = x.t AND m.b = x.after
      ) y WHERE best IS NOT NULL
    ) z
  ) v
)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE t IS NOT NULL GROUP BY w
"""
DECODE = "SELECT d, string_agg(letters, '' ORDER BY p) AS letters FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM given_ids) JOIN vocabulary USING (id) GROUP BY d"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file on the driver: the folder QUILLMARK_TOKENIZERS names, else the installed package, else /opt/tokenizers."""
    if folder := os.environ.get("QUILLMARK_TOKENIZERS"):
        return str(Path(folder, name))
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.submodule_search_locations[0] if spec else "/opt/tokenizers", name))


def _letters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: printable Latin-1 bytes are themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes words with one vocabulary, given as the bytes of its file; one per Python worker."""

    def __init__(self, file: bytes):
        import duckdb
        import pyarrow as pa
        import regex

        model = json.loads(file.decode("utf-8"))["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = _letters()
        self.first, self.byte = [vocab[c] for _, c in sorted(letters.items())], {c: b for b, c in letters.items()}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        pairs = pa.table({"a": [vocab[a] for a, _ in merges], "b": [vocab[b] for _, b in merges], "made": [vocab[a + b] for a, b in merges]})
        self.db.register("given", pairs)
        self.db.execute("CREATE TABLE merges AS SELECT a::INT a, b::INT b, (row_number() OVER () - 1)::INT rank, made::INT made FROM given")
        self.db.register("given_vocabulary", pa.table({"id": list(vocab.values()), "letters": list(vocab)}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INT id, letters FROM given_vocabulary")

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet; a query takes words of QUERY_BYTES together, or one longer word."""
        import numpy as np
        import pyarrow as pa

        first = np.array(self.first, np.int32)
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raws])
        part = np.cumsum(sizes) // QUERY_BYTES
        for at, to in itertools.pairwise(np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(words)].tolist()):
            n = sizes[at:to]
            flat = first[np.frombuffer(b"".join(raws[at:to]), np.uint8)]
            starts = np.repeat(np.cumsum(n) - n, n)
            self.db.register("pieces", pa.table({"w": np.repeat(np.arange(to - at, dtype=np.int32), n), "p": (np.arange(len(flat)) - starts).astype(np.int32), "t": flat}))
            out = self.db.sql(CONTRACT).to_arrow_table()
            for w, ids in zip(out.column("w").to_pylist(), out.column("ids").to_pylist()):
                self.known[words[at + w]] = ids
            self.db.unregister("pieces")

    def decode(self, ids) -> list[str]:
        """The texts of an Arrow array of lists of ids: pieces joined to the vocabulary, aggregated in order."""
        import numpy as np
        import pyarrow as pa

        self.db.register("given_ids", pa.table({"d": np.arange(len(ids), dtype=np.int32), "ids": ids}))
        out = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("given_ids")
        texts = [""] * len(ids)
        for d, x in zip(out.column("d").to_pylist(), out.column("letters").to_pylist()):
            texts[d] = bytes(map(self.byte.__getitem__, x)).decode("utf-8", "surrogatepass")
        return texts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        if new := {w for ws in cut for w in ws if w not in known}:
            self.learn(sorted(new))
        return [[i for w in ws for i in known[w]] for ws in cut]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, file: bytes) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(file)
    return _encoders[path]


def encode_corpus(docs: DataFrame, key: str, text: str, path: str | None = None, count_only: bool = False) -> DataFrame:
    """docs -> (key, ids array<int>), or (key, n_tokens long) if count_only. One row per row of docs.

    Null and empty texts have the empty list (0 tokens). No special tokens are added; their strings are ordinary text.
    The driver reads the vocabulary (a few MB, fixed) and broadcasts it, so executors need no such file.
    """
    import pyarrow as pa

    path = path or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(it):
        enc = _encoder(path, sent.value)
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = enc.encode(part.column(1).to_pylist())
                out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, "n_tokens" if count_only else "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens long" if count_only else "ids array<int>"))


def decode_corpus(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded -> (key, text): the texts whose ids are given; no ids or null give the empty text."""
    import pyarrow as pa

    path = path or tokenizer_path()
    kind = encoded.schema[key].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(it):
        enc = _encoder(path, sent.value)
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.decode(part.column(1)), pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
