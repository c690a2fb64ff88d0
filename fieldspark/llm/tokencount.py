"""Token counts of whole texts by overlap resynchronisation.

A huge text is cut into chunks that overlap.  Each chunk is encoded by itself, with offsets; where two
chunks overlap, they are spliced at the first boundary that both have and that is proven stable: a
piece that begins with a blank behind a character that is not one.  No piece of the tokenizer's
pattern reaches over such a place whatever stands around it, and merges never leave a piece.  If an
overlap has no such boundary, the left chunk is encoded again with a wider overlap, up to the end of
the text.  The pieces themselves are counted by the tokenizer's own library, once for each different
piece of a batch; a bounded table keeps counts between batches.

Defined cases: null is the empty text, which has no tokens; strings of special tokens count as one
token each, as by the library's default; extra columns are not read; equal rows get equal counts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import segment as S
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy

CHUNK = 16384
OVERLAP = 64
LIMIT = 512
#: Code points that are cut into pieces at once, and piece counts that a task remembers.
BATCH_CHARS = 1 << 20
MEMORY = 300_000


class Counter:
    """Counts tokens of pieces with a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def chunk_pieces(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every text: the offsets of its pieces, and how many tokens each has."""
        cp, breaks = S.joined(texts)
        s, e = S.pieces(cp, True, breaks)
        _, at, inverse = np.unique(S.piece_hashes(cp, s, e), return_index=True, return_inverse=True)
        whole = "\0".join(texts)
        names = [whole[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [x for x in names if x not in self.known]
        for x, got in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.known[x] = len(got)
        counts = np.fromiter((self.known[x] for x in names), np.int64, len(names))[inverse]
        edge = np.searchsorted(s, np.r_[0, breaks])
        first = np.r_[0, breaks + 1]
        return [(s[a:b] - first[k], counts[a:b]) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:]))]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and the number of these."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return [p for p in parts if p], len(parts) - 1


@lru_cache(1)
def counter(path: str) -> Counter:
    """The process's counter: a tokenizer is read once, not once a task, and its library runs in the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def _spliced(counter: Counter, text: str, chunks: list[tuple[np.ndarray, np.ndarray]], chunk: int, overlap: int) -> int:
    """Tokens of a text from the pieces of its chunks; chunk k begins at k * chunk and has ``overlap`` more behind it."""
    total, begin, k = 0, 0, 0  # tokens and place of the last splice, the chunk that goes on from there
    while True:
        starts, counts = chunks[k][0] + k * chunk, chunks[k][1]
        width, nxt = overlap, k + 1
        while True:
            if nxt * chunk >= len(text):
                return total + int(counts[starts >= begin].sum())
            right = chunks[nxt][0] + nxt * chunk
            both = np.intersect1d(starts[(starts > nxt * chunk) & (starts > begin)], right, assume_unique=True)
            both = [p for p in both.tolist() if text[p].isspace() and S.char_classes()[ord(text[p])] == S.BLANK
                    and S.char_classes()[ord(text[p - 1])] != S.BLANK][:1]
            if both:
                break
            width *= 2
            end = (k + 1) * chunk + width
            while (nxt + 1) * chunk < min(end, len(text)) - overlap:
                nxt += 1  # the wider left chunk reaches behind whole chunks
            starts, counts = counter.chunk_pieces([text[k * chunk:end]])[0]
            starts = starts + k * chunk
            if end >= len(text):
                return total + int(counts[starts >= begin].sum())
        total += int(counts[(starts >= begin) & (starts < both[0])].sum())
        begin, k = both[0], nxt


def count_texts(counter: Counter, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Tokens of each text."""
    totals = np.zeros(len(texts), np.int64)
    queue, size = [], 0

    def settle():
        cut = [[t[a:a + chunk + overlap] for a in range(0, max(1, len(t)), chunk)] for _, t in queue]
        got = counter.chunk_pieces([c for x in cut for c in x])
        at = 0
        for (row, t), x in zip(queue, cut):
            mine = got[at:at + len(x)]
            at += len(x)
            totals[row] += int(mine[0][1].sum()) if len(x) == 1 else _spliced(counter, t, mine, chunk, overlap)

    for row, text in enumerate(texts):
        parts, special = counter.parts(text)
        totals[row] += special
        for p in parts:
            queue.append((row, p))
            size += len(p) + 1
        if size >= BATCH_CHARS:
            settle()
            queue, size = [], 0
    if queue:
        settle()
    return totals


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit``; the file must lie at the same path on every executor."""
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = pa.schema([("doc_id", arrow_type(docs, "doc_id")), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        library = counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count_texts(library, texts))], schema=schema)

    return docs.mapInArrow(tidy(run), f"doc_id {sql_type(docs, 'doc_id')}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
