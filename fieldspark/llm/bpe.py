"""Byte-pair encoding with word ends as a bounded-lookahead streaming transducer, and its decoder.

The sufficient lookahead follows from the merge list.  Let two texts agree up to some place.  At each
merge rank the place from which on their token boundaries differ can move left by one token at most:
by the left part of a merge whose right part begins at that place in one of the two.  The ranks of
such moves rise, and the right part of a later move must contain the left part of an earlier one on
its left edge.  The longest chain of moves, found by one pass over the merges, bounds the distance
over which text still to come can change tokens; those that end farther back are stable.  The
transducer encodes its buffer, gives out the stable tokens and goes on with the rest, so its memory
is the lookahead and one step, whatever the length of a word.

In a batch all short words are merged together in numpy, each different word once.  Texts may also be
fed in slices of any size (:class:`Encoder`), which cut nothing that normalisation, the pattern or a
merge may still change.

Defined cases: null is the empty text, which has no tokens; strings of special tokens become these
tokens; equal rows give equal results; extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldspark.llm import segment as S
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy

WORD_END = "</w>"
#: Bytes of a word from which on it is streamed; bytes added to the lookahead between two looks.
LONG_WORD = 256
STEP = 1024
#: Characters that are cut into words at once; words that a task remembers.
BATCH_CHARS = 1 << 20
MEMORY = 200_000


@cache
def byte_chars() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = np.array([vocab[c] for c in byte_chars()], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in byte_chars()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 20 | self.right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(keys))[order]
        self.bytes = {i: 1 for i in [*self.inner.tolist(), *self.final.tolist()]}
        for a, b, m in zip(self.left.tolist(), self.right.tolist(), self.made.tolist()):
            self.bytes[m] = self.bytes[a] + self.bytes[b]  # a part that is not made before fails here
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes of text to come that suffice to know whether a token is final."""
        longest = max(self.bytes.values())
        first_part = dict(zip(self.made.tolist(), self.left.tolist()))
        moved: dict[int, int] = {}  # by the token left of the differing place: how far that place has moved
        most = 0
        for a, b in zip(self.left.tolist(), self.right.tolist()):
            before, t = 0, b
            while t is not None:
                before = max(before, moved.get(t, 0))
                t = first_part.get(t)
            now = before + self.bytes[a]
            if now > moved.get(a, 0):
                moved[a] = now
            most = max(most, now)
        return most + longest

    def encode_bytes(self, words: list[bytes], closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words one behind the other, and the end of each word's ids; open words have no word end yet."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[data]
        if closed:
            last = np.cumsum(lens)[lens > 0] - 1
            ids[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(ids))
        while len(ids):
            key = ids[:-1] << 20 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.rank[at], len(self.keys))
            rank = np.r_[rank, len(self.keys)]
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(ids)])
            live = np.repeat(best < len(self.keys), size)
            if not live.all():
                done.append((place[~live], ids[~live], word[~live]))
                ids, word, place, rank = ids[live], word[live], place[live], rank[live]
                best, size = best[best < len(self.keys)], size[best < len(self.keys)]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # in a run of overlapping pairs (a a a) the first, third … are merged
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word, place = ids[keep], word[keep], place[keep]
        if not done:
            return ids, np.zeros(len(words), np.int64)
        place, ids, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return ids[order], np.cumsum(np.bincount(word, minlength=len(words)))


class WordStream:
    """Tokens of one word whose bytes come in slices; holds the lookahead and one step at most."""

    def __init__(self, merges: Merges):
        self.merges, self.open = merges, b""

    def push(self, data: bytes) -> list[int]:
        self.open += data
        out: list[int] = []
        while len(self.open) >= self.merges.lookahead + STEP:
            window = self.open[:self.merges.lookahead + STEP]
            ids, _ = self.merges.encode_bytes([window], closed=False)
            used = 0
            for t in ids.tolist():
                if used + self.merges.bytes[t] > STEP:
                    break
                used += self.merges.bytes[t]
                out.append(t)
            self.open = self.open[used:]
        return out

    def finish(self) -> list[int]:
        ids, _ = self.merges.encode_bytes([self.open])
        self.open = b""
        return ids.tolist()


def lowered(text: str) -> str:
    """Composed and lower-cased letter by letter (so without the form of a sigma that ends a word)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def _joins_left() -> frozenset[str]:
    """Characters that may merge with the one before them when a text is composed."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for cp in range(0x110000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d:
            out.add(chr(int(d.split()[1], 16)))
        if unicodedata.combining(c):
            out.add(c)
    return frozenset(out)


class Encoder:
    """Token ids of a text that is fed in slices, in constant memory (but for runs of combining marks)."""

    def __init__(self, merges: Merges, hold: int = 4096):
        self.merges, self.hold = merges, hold
        self.raw, self.low = "", ""  # not yet composed; composed, but not yet cut
        self.word: WordStream | None = None  # an open word that is longer than the hold
        self.kind = 0

    def feed(self, text: str) -> list[int]:
        self.raw += text
        cut = len(self.raw) - 1
        while cut > 0 and not (self.raw[cut].isascii() or self.raw[cut] not in _joins_left()):
            cut -= 1
        if cut > 0:
            self.low += lowered(self.raw[:cut])
            self.raw = self.raw[cut:]
        return self._cut(final=False)

    def finish(self) -> list[int]:
        self.low += lowered(self.raw)
        self.raw = ""
        return self._cut(final=True)

    def _close(self) -> list[int]:
        out = self.word.finish() if self.word else []
        self.word = None
        return out

    def _cut(self, final: bool) -> list[int]:
        out: list[int] = []
        kinds = S.char_classes()
        if self.word is not None:
            same = 0
            while same < len(self.low) and kinds[ord(self.low[same])] == self.kind:
                same += 1
            out += self.word.push(self.low[:same].encode())
            self.low = self.low[same:]
            if self.low or final:
                out += self._close()
        if self.word is None and (final or len(self.low) > self.hold):
            cp = S.code_points(self.low)
            s, e = S.pieces(cp, False)
            n = len(s)
            if not final:  # what may still grow, or become a contraction, waits
                while n and e[n - 1] > len(cp) - 4:
                    n -= 1
            ids, _ = self.merges.encode_bytes([self.low[a:b].encode() for a, b in zip(s[:n].tolist(), e[:n].tolist())])
            out += ids.tolist()
            rest = 0 if not n else int(e[n - 1])
            if not final and n < len(s) and s[n] == max(rest, int(s[n])) and e[n] == len(cp) and e[n] - s[n] > self.hold // 2:
                self.word, self.kind = WordStream(self.merges), int(kinds[cp[s[n]]])
                out += self.word.push(self.low[s[n]:].encode())
                self.low = ""
            else:
                self.low = "" if final else self.low[rest:]
        return out


class Decoder:
    """Text of token ids that come in slices: bytes are held until they make up a character."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.value = {c: b for b, c in enumerate(byte_chars())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        out = []
        for i in ids:
            t = self.merges.token[i]
            if t in self.merges.special:
                out.append(self.utf8.decode(b"", True) + t)
                continue
            end = t.endswith(WORD_END)
            out.append(self.utf8.decode(bytes(self.value[c] for c in (t[:-len(WORD_END)] if end else t)), end) + " " * end)
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class Texts:
    """Ids and listed tokens of whole texts, in batches; each different word is merged once."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        special = self.merges.special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def _strings(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join([self.merges.token[i] for i in ids]), len(ids)

    def _learn(self, words: list[str]) -> None:
        short, coded = [], []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > LONG_WORD:
                stream = WordStream(self.merges)
                self.known[w] = self._strings(stream.push(b) + stream.finish())
            else:
                short.append(w)
                coded.append(b)
        ids, ends = self.merges.encode_bytes(coded)
        ids, begin = ids.tolist(), 0
        for w, end in zip(short, ends.tolist()):
            self.known[w] = self._strings(ids[begin:end])
            begin = end

    def _slice(self, texts: list[str]) -> list[tuple[str, str, int]]:
        cp, breaks = S.joined(texts)
        s, e = S.pieces(cp, False, breaks)
        _, at, inverse = np.unique(S.piece_hashes(cp, s, e), return_index=True, return_inverse=True)
        whole = "\0".join(texts)
        names = [whole[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())]
        if len(self.known) > MEMORY:
            self.known.clear()
        self._learn([w for w in names if w not in self.known])
        found = [self.known[w] for w in names]
        ids, tokens, n = [f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found], np.int64)
        total = np.r_[0, np.cumsum(n[inverse])] if len(s) else np.zeros(1, np.int64)
        edge = np.searchsorted(s, np.r_[0, breaks])
        inverse = inverse.tolist()
        return [(" ".join([ids[u] for u in inverse[a:b]]), " ".join([tokens[u] for u in inverse[a:b]]), int(total[b] - total[a]))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by a blank, tokens joined by a blank, number of ids) of each text."""
        out: list[tuple[str, str, int]] = []
        plain: list[list[str]] = []
        size = 0

        def settle():
            cut = self._slice([lowered(p) for parts in plain for p in parts[0::2]])
            at = 0
            for parts in plain:
                mine = cut[at:at + (len(parts) + 1) // 2]
                at += len(mine)
                all_parts = [mine[0]]
                for t, m in zip(parts[1::2], mine[1:]):
                    all_parts += [self._strings([self.merges.special[t]]), m]
                ids, tokens, n = zip(*all_parts)
                out.append((" ".join(filter(None, ids)), " ".join(filter(None, tokens)), sum(n)) if len(parts) > 1 else mine[0])

        for text in texts:
            plain.append(self.special.split(text) if self.special and "<" in text else [text])
            size += len(text) + 1
            if size >= BATCH_CHARS:
                settle()
                plain, size = [], 0
        if plain:
            settle()
        return out


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_tokens and digests of every text, with ``keep`` also its ids and decoded tokens as texts.

    The tokenizer file must lie at the same path on every executor.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col)
    more = [("ids", pa.string()), ("decoded", pa.string())] if keep else []
    schema = pa.schema([("doc_id", arrow_type(docs, "doc_id")), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more])

    def run(batches):
        coder = Texts(tokenizer_path)
        for batch in batches:
            column = batch.column(1)
            row = 0
            while row < batch.num_rows:  # some rows at a time, so that long texts do not pile up
                part = [t or "" for t in column.slice(row, 256).to_pylist()]
                got = coder.encode(part)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                columns = {"doc_id": batch.column(0).slice(row, len(part)), "n_tokens": pa.array([g[2] for g in got], pa.int64()),
                           "ids_sha256": pa.array([sha(g[0]) for g in got]), "decoded_sha256": pa.array([sha(g[1]) for g in got])}
                if keep:
                    columns |= {"ids": pa.array([g[0] for g in got]), "decoded": pa.array([g[1] for g in got])}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
                row += len(part)

    return docs.mapInArrow(tidy(run), f"doc_id {sql_type(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           + (", ids string, decoded string" if keep else ""))
